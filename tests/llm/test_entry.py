"""Registered queries of the folder against their SQL, and the pipeline against brute force."""

from __future__ import annotations

import random
import zlib

import duckdb
import pytest

from provgraph.llm.queries import QUERIES, SQL

from ..conftest import SF
from ..test_oracle import plain
from . import cases

TABLES = ("documents", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = con.sql(SQL[name])
    at = [result.columns.index(c) for c in columns]
    assert rows and rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_registered():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(QUERIES) <= set(known) and "pipeline" in known
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = cases.texts(4, 80)
    docs = cases.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    item = " ".join(cases.words(rows[25][1])[:12])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int("river" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    sf = str(tmp_path)

    kept = stages["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns

    alone = stages["exact dedup"](spark, docs, sf)
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault("".join(cases.words(t)), []).append((-len(t or ""), i))
    assert {r.doc_id for r in alone.collect()} == {min(g)[1] for g in groups.values()}

    near = stages["n-gram Jaccard join"](spark, docs, sf)
    label = cases.near_groups(rows)
    assert {r.doc_id for r in near.collect()} == {i for i in label if label[i] == i}

    clear = stages["benchmark decontamination"](spark, docs, sf)
    own = cases.shingles(item)
    assert {r.doc_id for r in clear.collect()} == {i for i, t in rows if 10 * len(own & cases.shingles(t)) < 8 * len(own)}
    assert len(own) and clear.count() < len(rows)

    last = stages["BPE encoding and decoding"](spark, docs, sf)
    assert last.columns == ["doc_id", "n_tokens", "ids", "decoded"] and last.count() == len(rows)
    assert pipeline.run(spark, sf).count() > 0
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        nulls = spark.createDataFrame([(None, None, None, None, None), (None, "x y", "en", "s", 3), (2, None, None, None, None)], docs.schema)
        assert stage(spark, nulls, sf).count() == (2 if name == "exact dedup" else 3), name


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages in a row on hostile rows, null and repeated ids among them."""
    import corpus_pipeline as pipeline
    from provgraph.llm import toxicity
    from provgraph.llm.shared import table

    rows = cases.texts(7, 90) + [(None, "same text here"), (30, "same text here"), (30, "same  text here"), (30, "a text that no other row has"), (None, None)]
    docs = cases.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    items = [(1, " ".join(cases.words(rows[25][1])[:12])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int("river" in (t or ""))) for i, t in rows if i is not None and i < 60], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    model = toxicity.train(docs, table(spark, sf, "labels"))
    scored = {(t, g): rejects(model, t, g) for t, g in docs.select("text", "lang").distinct().collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if not scored[r.text, r.lang]]
    assert 0 < len(left) <= len(rows)
    groups: dict[str, list] = {}
    for i, t in left:
        groups.setdefault("".join(cases.words(t)), []).append((-len(t or ""), i is None, i or 0, t or ""))
    left = [(None if null else i, t) for _, null, i, t in map(min, groups.values())]
    label = cases.near_groups(list(enumerate(t for _, t in left)))
    firsts: dict[int, list] = {}
    for k, (i, t) in enumerate(left):
        firsts.setdefault(label[k], []).append((i is None, i or 0, t))
    left = [(None if null else i, t) for null, i, t in map(min, firsts.values())]
    own = cases.shingles(items[0][1])
    left = [(i, t) for i, t in left if 10 * len(own & cases.shingles(t)) < 8 * len(own)]
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [(i, lib.encode(t, add_special_tokens=False).ids) for i, t in left]
    want = [(i, len(x), x, lib.decode(x, skip_special_tokens=False)) for i, x in ids]
    got = [(r.doc_id, r.n_tokens, list(r.ids), r.decoded) for r in pipeline.run(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 8


def test_pipeline_learns_from_every_labelled_row(spark, tmp_path):
    """Its first stage drops a text for a word whose labelled rows all come late in the order of the ids' hash."""
    import corpus_pipeline as pipeline

    cases.late_word(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id for r in dict(pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path)).collect()}
    bad = {r.doc_id for r in docs.collect() if "zorblax" in r.text}
    assert -1 in bad and -2 in left
    assert len(bad) > 200 and len(left & bad) < 0.02 * len(bad)
    assert len(left) > 0.95 * (13_000 * 2 / 3)


def test_pipeline_model_and_thresholds_come_from_every_labelled_row(spark, tmp_path, monkeypatch):
    """A word of every fourth labelled row alone is learnt, and a language's threshold counts the positives of all rows."""
    import corpus_pipeline as pipeline
    import pyarrow as pa
    from pyspark.sql import functions as F

    from provgraph.llm import toxicity

    order = [r.id for r in spark.range(600).orderBy(F.xxhash64("id"), "id").collect() if zlib.crc32(str(r.id).encode()) % 4 != 2]
    r, rows = random.Random(3), []
    for k, i in enumerate(order):
        bad = (" zorblax" if k % 4 == 3 else " blargh") * (k % 3 == 0)
        rows.append((i, " ".join(f"word{r.randrange(90)}" for _ in range(5)) + bad, "en" if k % 5 else "de", int(k % 3 == 0)))
    positives = [k % 4 for k, (*_, lang, toxic) in enumerate(rows) if lang == "de" and toxic]
    assert positives.count(3) < toxicity.LEAST <= len(positives)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    docs.selectExpr("doc_id", "1 quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    models = []
    monkeypatch.setattr(toxicity, "drop_toxic", lambda docs, model: models.append(model) or docs)
    dict(pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path))
    bad, good = toxicity.probabilities(models[0], pa.array(["word1 word2 zorblax word3", "word1 word2 word4 word3"]))
    assert bad > 0.9 and good < 0.1
    assert set(models[0].by_language) == {"en", "de"}


def rejects(model, text, lang) -> bool:
    import pyarrow as pa

    from provgraph.llm import toxicity

    return bool(toxicity.rejected(model, toxicity.probabilities(model, pa.array([text or ""])), pa.array([lang]))[0])
