"""Word bounds and case of the text expressions, as SQL's engine reads them."""

from __future__ import annotations

import duckdb

from provgraph.catalog.text import SQL
from provgraph.functions import text as fx
from provgraph.operators import structure

TEXTS = ["éno", "noé", "plain", "no", "it may\u0301 be", "ümight", "ſeems", "lac\u212a", "was lac\u212aed", "x ſuspected y", None, "", "café not é", "éé", "ＮＯ ١no", "no_", "_may"]


def test_polarity_and_modality_beside_other_letters(spark):
    rows = list(enumerate(TEXTS))
    frame = spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", fx.polarity("text").alias("p"), fx.modality("text").alias("m"))
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, frame.collect())) == sorted(con.sql(SQL["polarity_modality"]).fetchall())


def test_templates_and_mails_beside_other_letters(spark):
    rows = [(0, "é12 of 12é"), (1, "12 of 13"), (2, "épost@a.de"), (3, "say post@a.de")]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    made = structure.template_counts(structure.lines(frame, "doc_id", "text"), "doc_id", "line")
    assert {r.template for r in made.collect()} == {"é<NUM> of <NUM>é", "<NUM> of <NUM>", "épost@a.de", "say post@a.de"}
    mails = frame.select("doc_id", fx.matches("text", fx.EMAIL).alias("m")).collect()
    assert sorted((r.doc_id, x) for r in mails for x in r.m) == sorted(con.sql(SQL["emails_extract"]).fetchall())
