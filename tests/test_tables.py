"""Table functions say what the column forms say, over whole tables."""

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.queries.all_queries import QUERIES
from palimpsest.sources.derived import load

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chunks_and_snippets_are_the_column_forms(spark):
    docs, said = load(spark, SF, "documents"), load(spark, SF, "said")
    assert rows(QUERIES["f_chunks"](spark, SF)) == rows(tx.chunks(docs.select("doc_id", "text"), max_chunks=None).select("doc_id", "position", "chunk"))
    assert rows(QUERIES["f_snippets"](spark, SF)) == rows(said.select("turn_id", "seq", F.posexplode(tx.split_said(F.col("text"))).alias("position", "snippet")))
    odd = spark.createDataFrame([(0, "intro\n- one\n- two\n\nend  of it"), (1, None), (2, " \n\n "), (3, "1) a\n2) b")], "i int, text string")
    got = spark.sql("SELECT o.i, s.* FROM {o} o, LATERAL snippets(o.text, 5) s", o=odd)
    assert rows(got) == rows(odd.select("i", F.posexplode(tx.split_said(F.col("text"), 5)).alias("position", "snippet")))


def test_lines_of_facts_are_the_timeline(spark):
    lines = QUERIES["v_timeline"](spark, SF).select("subject_id", "predicate", "fact_id", "valid_from", "valid_to")
    assert rows(QUERIES["f_fact_lines"](spark, SF)) == rows(lines)
