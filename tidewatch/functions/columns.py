"""Scalar column expressions shared by the operators (JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same alerts.
# Allowed service ports (no alert below 1024 when listed here):
COMMON_PORTS = [22, 25, 53, 80, 110, 123, 143, 443, 445, 993, 995, 3306, 3389, 5432, 8080, 8443]
# Watched ports (always alert):
UNUSUAL_PORTS = [7, 9, 19, 21, 23, 135, 137, 139, 389, 502, 2323, 3128, 4444, 6660, 6661, 6662,
                 6663, 6664, 6665, 6666, 6667, 6668, 6669, 12345, 31337, 44444, 65535]
# Alert types whose presence makes a MITM verdict critical:
CRITICAL_TYPES = ["SESSION_HIJACKING", "DNS_POISONING"]
# Alert texts:
DETAIL_UNUSUAL = "Traffic on unusual port %d/%s"
DETAIL_SCAN = "%s contacted %d unique ports — possible scan"
DETAIL_ARP = "ARP packet detected — possible MITM reconnaissance"
# Feature value bands, in arm order (near-normal, then the five ranges):
BAND_TEXT = ["was near-normal", "unusually low", "lower than normal", "unusually high",
             "higher than normal", "within normal range"]
DIRECTION_TEXT = ["increased the attack score", "decreased the attack score (pushed toward benign)"]
NARRATIVE_HEAD = "Alert triggered primarily by: "
# ---------------------------------------------------------------------------

# Own text for features without a description of their own.
DEFAULT_FEATURE_TEXT = "No description is kept for this feature."


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cic_label(c) -> Column:
    """CIC label text -> 0/1: trimmed 'BENIGN' is 0, anything else (null too) 1."""
    return F.when(F.trim(col_(c)) == "BENIGN", 0).otherwise(1)


def unsw_label(c) -> Column:
    """UNSW attack category -> 0/1: 'normal' (any case, trimmed) is 0."""
    return F.when(F.lower(F.trim(col_(c))) == "normal", 0).otherwise(1)


def label_text(c) -> Column:
    return F.when(col_(c) == 1, "Attack").otherwise("Benign")


def correct_flag(decision, true_label) -> Column:
    """1 when the analyst's decision text matches the true label."""
    expected = F.when(col_(true_label) == 1, "attack").otherwise("benign")
    return (col_(decision) == expected).cast("int")


def is_unusual_port(dport) -> Column:
    d = col_(dport)
    return d.isin(UNUSUAL_PORTS) | ((d < 1024) & ~d.isin(COMMON_PORTS))


def value_band(z, near_normal: bool = True) -> Column:
    """Describe a scaled feature value (BAND_* texts). Arm order matters; the
    summary variant (``near_normal=False``) has no near-normal arm."""
    z = col_(z)
    rest = (F.when(z < -0.5, BAND_TEXT[1]).when(z < -0.2, BAND_TEXT[2])
            .when(z > 0.5, BAND_TEXT[3]).when(z > 0.2, BAND_TEXT[4])
            .otherwise(BAND_TEXT[5]))
    if near_normal:
        return F.when(F.abs(z) < 0.1, BAND_TEXT[0]).otherwise(F.concat(F.lit("was "), rest))
    return rest


def direction(contribution) -> Column:
    return F.when(col_(contribution) > 0, DIRECTION_TEXT[0]).otherwise(DIRECTION_TEXT[1])


def pushed_toward(contribution) -> Column:
    return F.when(col_(contribution) > 0, "pushed toward **attack**").otherwise("pushed toward **benign**")


def severity(types) -> Column:
    """MITM verdict severity from an ARRAY<STRING> of alert types."""
    t = col_(types)
    crit = F.array(*[F.lit(x) for x in CRITICAL_TYPES])
    return (F.when(F.coalesce(F.arrays_overlap(t, crit), F.lit(False)), "critical")
            .when(F.coalesce(F.size(t), F.lit(0)) > 0, "high").otherwise("none"))


def band(value, cuts: list[float], names: list[str]) -> Column:
    """names[i] for the first cut with value < cuts[i]; names[-1] otherwise."""
    v = col_(value)
    expr = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names[:-1]))):
        expr = F.when(v < cut, F.lit(name)).otherwise(expr)
    return expr


def question_code(label) -> Column:
    """'3 - Neutral' -> 3."""
    return F.substring(col_(label), 1, 1).cast("int")
