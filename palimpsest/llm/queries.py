"""The thin queries op1 to op13 over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bagminhash, chatformat, chatrepair, decontaminate, embeddup, fim, htmltext, langid, linededup, mixing, quality, substrings, urlfilter

#: Host and path rules of the URL query: (verdict, host/path).
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]
PREDICT_AT = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the benchmark items that it holds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("bench_items") > 0).alias("contaminated"), F.array_join("bench_items", ",").alias("item_ids"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: predicted language and calibrated probability."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = langid.train(docs, ~held)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text without the boilerplate lines of its source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = linededup.drop_boilerplate(docs)
    return out.select("doc_id", "source", "text", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_dropped").alias("n_dropped"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: quality score and prediction."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = quality.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"), ~held)
    out = quality.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= PREDICT_AT).cast("int").alias("predicted"))


def op5_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the main text."""
    out = htmltext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its near-duplicate class."""
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chatformat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: counts and digests read back from its formatted blocks."""
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chatformat.digests(chatformat.format_conversations(chatformat.rows_as_events(rows.unionByName(extra))))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words of it that the mix takes."""
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op9_embeddup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: links, component and whether it is kept."""
    return embeddup.link_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, rule and verdict; labels for the trees come from words of host names."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = urlfilter.host_path(F.col("url"))
    labelled = pages.where("url is not null").select("url", urlfilter.word_label(host).alias("label"))
    out = urlfilter.judge(pages, labelled, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))


def op11_chatrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, after damage: faults, the cheapest repair, and the digest of the repaired text."""
    return chatrepair.digests(chatrepair.damage(_table(spark, sf_dir, "conversations")))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: units, form, lengths, and digests of the output and of the text rebuilt from it."""
    out = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return out.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest(F.col("fim.output")).alias("output_sha256"),
        digest(fim.restore(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, how many of them repeat 13 words of an earlier document, and the digest of the rest."""
    out = substrings.drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "substring_dedup.n_words", "substring_dedup.n_removed", F.sha2("substring_dedup.text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_decontaminate, op2_langid, op3_linededup, op4_quality, op5_htmltext, op6_minhash, op7_chatformat, op8_mixing, op9_embeddup, op10_urlfilter,
    op11_chatrepair, op12_fim, op13_substrings,
)}

_LINE_SQL = f"""
WITH lines AS (
  SELECT rid, doc_id, source, i, line FROM (
    SELECT rid, doc_id, source, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (
      SELECT row_number() OVER () AS rid, doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
seen AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT rid) AS c FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
pages AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
bad AS (SELECT s.source, s.line FROM seen s JOIN pages p ON s.source IS NOT DISTINCT FROM p.source
        WHERE s.c >= {linededup.MIN_PAGES} AND s.c > {linededup.RATIO} * p.n),
kept AS (SELECT l.rid, any_value(l.doc_id) AS doc_id, any_value(l.source) AS source, count(*) AS n_lines,
                count(b.line) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS text
         FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line GROUP BY l.rid)
SELECT doc_id, source, text, n_lines, n_dropped FROM kept
UNION ALL SELECT doc_id, source, text, 0, 0 FROM documents WHERE text IS NULL
"""


def _escaped(c: str) -> str:
    out = f"replace({c}, '{chatformat.ESC}', '{chatformat.ESC}0')"
    for s in chatformat.CONTROLS:
        out = f"replace({out}, '{s}', '{s[0]}{chatformat.ESC}1{s[1:]}')"
    return out


_CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum({len(chatformat.START) + len(chatformat.END) + 2} + length(replace({_escaped('role')}, chr(10), '{chatformat.ESC}2'))
           + length({_escaped('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_TIER_SQL = " + ".join(f"(size * n_docs < {c}::DOUBLE * source_size)::INT" for c in mixing.TIERS)


def _cut_sql(t: int) -> str:
    """CTEs s{t}, c{t}, w{t}: the share of the surplus, the cut of one tier of sizes, and what has been taken up to it; a source without this tier goes on unchanged."""
    said = f"w{t - 1}" if t else "(SELECT source, rate - floor(rate) AS f, 0::BIGINT AS taken, 0::BIGINT AS before, source_size AS rest, 0.0::DOUBLE AS var FROM rates)"
    spread = f"({mixing.DEVIATIONS}::DOUBLE * sqrt(var))"
    return f"""s{t} AS (SELECT s.*, coalesce(r.words, 0) AS words, coalesce(r.squares, 0)::DOUBLE AS squares,
    CASE WHEN var > 0 AND rest > 0 THEN least(1.0::DOUBLE, f * rest / least((1.0::DOUBLE - f) * before, {spread}), (1.0::DOUBLE - f) * rest / least(f * before, {spread})) ELSE 0.0::DOUBLE END AS share
  FROM {said} s LEFT JOIN (SELECT source, sum(size)::BIGINT AS words, sum(size::HUGEINT * size)::DOUBLE AS squares FROM drawn WHERE tier = {t} GROUP BY 1) r ON s.source IS NOT DISTINCT FROM r.source),
c{t} AS (SELECT *, floor(CASE WHEN share > 0 THEN greatest(least(f - share * (taken - f * before) / rest, 1.0::DOUBLE), 0.0::DOUBLE) ELSE f END * {mixing.STEPS} + 0.5)::INT AS cut,
    CASE WHEN rest > 0 THEN 1.0::DOUBLE - share * words / rest ELSE 1.0::DOUBLE END AS kept FROM s{t}),
w{t} AS (SELECT source, f, taken + coalesce((SELECT sum(d.size) FROM drawn d WHERE d.source IS NOT DISTINCT FROM c.source AND d.tier = {t} AND d.coin < c.cut), 0)::BIGINT AS taken,
    (before + words)::BIGINT AS before, (rest - words)::BIGINT AS rest, var * kept * kept + f * (1.0::DOUBLE - f) * squares AS var FROM c{t} c)"""


_MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('SEED:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 3))::INT AS coin FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM per),
weighed AS (SELECT *, ([3.0, 1.0, 2.0])[((r - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM ranked),
level AS (SELECT *, cap / w AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv
  FROM weighed WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(lv, ratio * 1.0) AS lv FROM (SELECT * FROM level WHERE lv <= ratio ORDER BY ratio, r LIMIT 1)),
targets AS (SELECT source, n_docs, source_size, CASE WHEN water.lv IS NULL THEN cap ELSE least(cap, water.lv * w) END AS target FROM level LEFT JOIN water ON TRUE),
rates AS (SELECT source, n_docs, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
drawn AS (SELECT d.doc_id, d.source, d.size, d.coin, t.source_size, t.target, t.rate, TIER AS tier
  FROM sized d JOIN rates t ON d.source IS NOT DISTINCT FROM t.source),
CUTS,
cuts AS (ALL_CUTS)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * (floor(d.rate) + (d.coin < c.cut)::INT))::BIGINT AS taken
FROM drawn d JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source AND d.tier = c.tier
""".replace("SEED", str(mixing.SEED)).replace("TIER", _TIER_SQL).replace("ALL_CUTS", " UNION ALL ".join(
    f"SELECT source, {t} AS tier, cut FROM c{t}" for t in range(len(mixing.TIERS) + 1))).replace("CUTS", ", ".join(map(_cut_sql, range(len(mixing.TIERS) + 1))))

_LINK_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
walk AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT w.a, p.b FROM walk w JOIN pairs p ON w.b = p.a),
comp AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

_REPAIR_SQL = r"""
WITH RECURSIVE crc(i, c) AS (SELECT range, list_reduce([range] || range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END) FROM range(256)),
crcs AS (SELECT list(c ORDER BY i) AS t FROM crc),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
drawn AS (SELECT r.*, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(t[(xor(c, b) % 256) + 1], c // 256))) % 20 AS k FROM raw r, crcs),
hit AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM drawn, range(0, CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hit),
judged AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM placed),
rows_ AS (SELECT *, blank OR dup AS must, open AND NOT blank AND NOT dup AS trunc, left(role, 1) AS ini FROM judged),
facts AS (SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE dup AND NOT blank) AS duplicate, count(*) FILTER (WHERE trunc) AS truncated,
    count(*) FILTER (WHERE prev IS NOT NULL AND left(prev, 1) || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows_ GROUP BY conv_id),
step(conv_id, i, z, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {'c': 0, 'l': ''}, {'c': 1000000, 'l': ''}, {'c': 1000000, 'l': ''}, {'c': 1000000, 'l': ''} FROM facts
  UNION ALL
  SELECT conv_id, i, {'c': z.c + 4, 'l': z.l || 'D'},
    list_min([{'c': s.c + 4, 'l': s.l || 'D'}, CASE WHEN NOT must AND ini = 's' THEN {'c': z.c + t, 'l': z.l || 'K'} END]),
    list_min([{'c': u.c + 4, 'l': u.l || 'D'}] || CASE WHEN must THEN [] ELSE [{'c': x.c + CASE ini WHEN 'u' THEN t ELSE t + 3 END, 'l': x.l || CASE ini WHEN 'u' THEN 'K' ELSE 'R' END} for x in [z, s, a]] END),
    list_min([{'c': a.c + 4, 'l': a.l || 'D'}, CASE WHEN NOT must THEN {'c': u.c + CASE ini WHEN 'a' THEN t ELSE t + 3 END, 'l': u.l || CASE ini WHEN 'a' THEN 'K' ELSE 'R' END} END])
  FROM (SELECT p.conv_id, r.i, z, s, must, ini, CASE WHEN trunc THEN 3 ELSE 0 END AS t,
      list_min([u] || [{'c': x.c + 3, 'l': x.l || 'I'} for x in [z, s, a]]) AS u, list_min([a, {'c': u.c + 3, 'l': u.l || 'I'}] || [{'c': x.c + 6, 'l': x.l || 'II'} for x in [z, s]]) AS a
    FROM step p JOIN rows_ r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i + 1)),
best AS (SELECT f.conv_id, list_min([z, a, {'c': u.c + 3, 'l': u.l || 'I'}] || [{'c': x.c + 6, 'l': x.l || 'II'} for x in [z, s]]) AS b FROM facts f JOIN step p ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = f.n),
letters AS (SELECT conv_id, j, b.l[j] AS l FROM (SELECT conv_id, b, unnest(range(1, length(b.l) + 1)) AS j FROM best)),
edits AS (SELECT *, count(*) FILTER (WHERE l <> 'I') OVER w AS i, count(*) FILTER (WHERE l <> 'D') OVER w AS k FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
outs AS (SELECT e.*, r.role, r.text, max(CASE WHEN e.k = 1 AND l = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS sys
    FROM edits e LEFT JOIN rows_ r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i AND l <> 'I' WHERE l <> 'D'),
mended AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (k - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS said FROM outs GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.l, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
  LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN mended m ON o.conv_id IS NOT DISTINCT FROM m.conv_id
"""

_FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""

_SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
wins AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT s, min(doc_id) AS least FROM wins GROUP BY s),
gone AS (SELECT DISTINCT rid, i + j AS i FROM (SELECT rid, i FROM wins JOIN firsts USING (s) WHERE least < doc_id), range(0, 13) r(j)),
said AS (SELECT rid, i, w[i] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT rid, count(g.i) AS n_removed, string_agg(s.word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL) AS text FROM said s LEFT JOIN gone g USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_linededup": _LINE_SQL, "op7_chatformat": _CHAT_SQL, "op8_mixing": _MIX_SQL, "op9_embeddup": _LINK_SQL,
    "op11_chatrepair": _REPAIR_SQL, "op12_fim": _FIM_SQL, "op13_substrings": _SUBSTRING_SQL,
}
