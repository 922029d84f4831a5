import random

import pytest

import corpus_pipeline
from helpers import SCHEMA, components, contamination, edge_rows, later_lines, prose, row
from lingua_spark.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(12)
    rows = edge_rows()
    rows += [row(5000 + i, prose(rng, 40) + (" badword stinkword awfulword" if i % 3 == 0 else "") + "\n" + prose(rng, 10)) for i in range(90)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5000 + i, 0, int(i % 3 == 0)) for i in range(90)] + [(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, " ".join(edge_rows()[11][1].split()[3:30])), (2, prose(rng, 30)), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def test_each_stage_against_brute_force(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        out = stage(spark, docs, d)
        if name != "bpe":
            assert out.columns == docs.columns
        got = sorted(map(tuple, out.select("doc_id", "text").collect()), key=str) if name != "bpe" else None
        kept[name] = got
        if name == "toxicity":
            toxic = [b for b in before if "stinkword" in (b[1] or "")]
            assert len(toxic) == 30 and got == [b for b in before if b not in toxic]
        elif name == "line_dedup":
            gone = later_lines(sorted({b for b in before if b[0] is not None}, key=str))
            want = []
            for i, t in before:
                lines = (t or "").split("\n")
                left = [x for k, x in enumerate(lines) if (i, k) not in gone]
                if left:
                    want.append((i, t if len(left) == len(lines) else "\n".join(left)))
            assert got == sorted(want, key=str)
        elif name == "near_dedup":
            label = components(before)
            assert sorted(str(g[0]) for g in got) == sorted(str(i) for i in {b[0] for b in before if b[0] is not None and label[b[0]] == b[0]}) + \
                ["None"] * sum(b[0] is None for b in before) or sorted(str(g[0]) for g in got) == sorted(
                    [str(i) for i in label if label[i] == i] + ["None"] * sum(b[0] is None for b in before))
        elif name == "decontamination":
            assert got == [b for b in before if not contamination(b[1], items)[1]]
            assert len(got) < len(before)
        else:
            assert out.count() == len(before)
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run(spark, folder):
    d, _, _ = folder
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    ids = {r["doc_id"] for r in got.collect()}
    assert ids and not ids & set(range(5000, 5090, 3))
    assert {5000 + i for i in range(90) if i % 3} <= ids


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    import duckdb
    from scripts.check_oracle import rows_of
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())
