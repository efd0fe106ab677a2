"""The pipeline against its plain version, and every registered query."""

import random
from collections import defaultdict

import brute
import duckdb
import pytest
from test_packing_mixing import check_pieces, ids_of

import __spark_entry__ as entry
import corpus_pipeline
from tidewatch.llm import mixing, queries

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    rows = []
    shared = [brute.make_text(rng, 60, 5) for _ in range(3)]
    for i in range(120):
        text = brute.make_text(rng, rng.randint(5, 150), 6)
        if i % 4 == 0:
            text += "\n" + rng.choice(shared) + "\n" + brute.make_text(rng, 20, 6)
        if i % 10 == 9:
            text = rows[-1][1]
        if i % 17 == 3:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, rng.choice(["en", "de", None]), f"src{rng.randrange(5)}"))
    words = rows[1][1].split(" ")
    for i in range(5):
        words[(i * 7) % len(words)] = "cor"
        rows.append((200 + i, " ".join(words), "en", "src0"))
    rows += [(300, None, "en", "src1"), (301, "", None, None), (302, " \n ", "en", "src1")]
    return rows


def plain_pipeline(rows):
    rows = [r for r in rows if brute.kept_by_rules(r[1])]
    rows = [(d, t, *r[2:]) for r, (d, t, _) in zip(rows, brute.dedup_lines([r[:2] for r in rows]), strict=True)]
    keep = {c for _, _, c in brute.near_components([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] in keep]
    copies = brute.mix(rows, mixing.SHARE_PERCENT, 1, mixing.SEED, mixing.WEIGHTS)
    return [r for r in rows if copies[r[0]]]


def test_pipeline_matches_plain_version(spark, tmp_path):
    rows = corpus(random.Random(12))
    data = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(data, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_pipeline(rows)
    assert 10 < len(want) < len(rows) - 20
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in want}
    check_pieces(out, {(r[0], len(ids_of(r[1]))): [ids_of(r[1])] for r in want})


def test_stages_return_the_columns_of_documents(spark):
    rows = corpus(random.Random(13))
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], COLUMNS + ", fp string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SF)
            assert out.dtypes == docs.dtypes, name
            if d is docs:
                got = out.collect()
                assert all(r.n_chars == len(r.text or "") for r in got)
            else:
                assert out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "packing"]


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(queries.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    assert got == sorted(tuple(str(r[at[c]]) for c in cols) for r in cur.fetchall())


def test_near_duplicates_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.queries()["op5_simhash_multi_index"](spark, SF).collect())
    assert got == sorted(brute.near_components(rows))


def test_packing_of_the_table(spark):
    ids = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids[(r.doc_id, len(ids_of(r.text)))].append(ids_of(r.text))
    assert check_pieces(queries.queries()["op7_vector_packing"](spark, SF).collect(), ids) < 0.02
