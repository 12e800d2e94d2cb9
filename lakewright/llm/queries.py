"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_windows,
    collocations,
    decontamination,
    fill_in_middle,
    html_blocks,
    licenses,
    paragraphs,
    quality,
    repeated_bytes,
    sentencepieces,
    simhash,
    toxicity,
    transport_stream,
)
from .common import table, written
from .training import remainder


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.digest(decontamination.contamination(docs, bench))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder("doc_id", 3) != 1)
    return toxicity.digest(toxicity.score(docs, model), remainder("doc_id", 3) == 1)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media(table(spark, sf_dir, "documents"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, remainder("doc_id", 5) != 0)
    return quality.digest(quality.score(docs, model), remainder("doc_id", 5) == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), model_path())


def op9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.paragraph_duplicates(table(spark, sf_dir, "documents"))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.remove_repeats(table(spark, sf_dir, "documents"))


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_windows.digest(chat_windows.windows(turns))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = written(fill_in_middle.store(table(spark, sf_dir, "documents")))
    return fill_in_middle.digests(kept).drop("n_frames")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_transport_stream": op4_transport_stream,
    "op5_html_blocks": op5_html_blocks,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_sentencepieces": op8_sentencepieces,
    "op9_paragraphs": op9_paragraphs,
    "op10_repeated_bytes": op10_repeated_bytes,
    "op11_chat_windows": op11_chat_windows,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_collocations": op13_collocations,
}

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op1_decontamination": r"""WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ip AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM ip),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT d.r, d.i, d.n, win.item FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM dp) d JOIN win USING (n, x)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op11_chat_windows": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, coalesce(floor(turn / 512.0)::BIGINT, -4611686018427387904) AS block, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]')) + 4 AS n,
  25 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*/?turn')) + len(regexp_extract_all(text, '<\\*/?turn')) AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role <> 'system', role, text) AS nth FROM c),
own AS (SELECT *, role = 'system' AND nth = 1 AS sys FROM t),
conv AS (SELECT conv_id, min(block) AS opens, coalesce(max(CASE WHEN sys THEN n END), 0) AS s, coalesce(max(CASE WHEN sys THEN chars END), 0) AS sc, bool_or(sys) AS has FROM own GROUP BY conv_id),
r AS (SELECT conv_id, block, 2 AS kind, turn, role, text, n, chars, nth FROM own WHERE NOT sys UNION ALL SELECT conv_id, block + 1, 1, turn, role, text, n, chars, nth FROM own WHERE turn - block * 512 >= 448 AND NOT sys),
p AS (SELECT r.*, opens, s, sc, has, greatest(2048 - 256 - s, 512) / 2.0 AS half,
  sum(n) OVER (PARTITION BY r.conv_id, block ORDER BY kind, nth ROWS UNBOUNDED PRECEDING) - n - sum(CASE WHEN kind = 1 THEN n ELSE 0 END) OVER (PARTITION BY r.conv_id, block) AS pos
  FROM r JOIN conv ON r.conv_id IS NOT DISTINCT FROM conv.conv_id),
q AS (SELECT *, CASE WHEN kind = 1 THEN 0 ELSE floor(pos / half)::BIGINT END AS own_bucket, greatest(floor((pos + 256) / half)::BIGINT, CASE WHEN kind = 1 THEN -1 ELSE floor(pos / half)::BIGINT END) AS last FROM p),
x AS (SELECT *, unnest(range(own_bucket, last + 1)) AS bucket FROM q),
y AS (SELECT *, CASE WHEN kind = 1 OR bucket > own_bucket THEN 1 WHEN n > half THEN 3 ELSE 2 END AS k FROM x),
z AS (SELECT *, max(CASE WHEN k = 3 THEN pos END) OVER g AS long_at, bool_or(k = 2) OVER g AS fresh FROM y WINDOW g AS (PARTITION BY conv_id, block, bucket)),
w AS (SELECT conv_id, block, bucket, 0 AS part, sum(chars) + any_value(sc) AS chars, sum(n) + any_value(s) AS n FROM z WHERE fresh AND k < 3 GROUP BY conv_id, block, bucket
  UNION ALL SELECT conv_id, block, bucket, 1, sum(chars) + any_value(sc), sum(n) + any_value(s) FROM z WHERE pos BETWEEN long_at - 256 AND long_at GROUP BY conv_id, block, bucket
  UNION ALL SELECT conv_id, opens, 0, 0, sc, s FROM conv WHERE has AND NOT EXISTS (SELECT 1 FROM z WHERE z.conv_id IS NOT DISTINCT FROM conv.conv_id AND z.block = opens AND z.bucket = 0 AND z.k > 1)),
f AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars, count(*) AS n_windows, sum((n > 2048)::BIGINT)::BIGINT AS n_over_budget FROM w GROUP BY conv_id),
h AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256 FROM own GROUP BY conv_id)
SELECT h.*, formatted_chars, n_windows, n_over_budget FROM h JOIN f ON h.conv_id IS NOT DISTINCT FROM f.conv_id""",
    "op12_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
r AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256 FROM p""",
    "op13_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, any_value(m) AS m, count(*) AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, a, k.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 :], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
j AS (SELECT lang, a, w, m, unnest(range(2, m)) AS k FROM c WHERE m > 2),
q AS (SELECT lang, a, w, k, unnest(range(1, m - k + 2)) AS i FROM j),
u AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(a) AS around FROM q GROUP BY 1, 2),
d AS (SELECT b.* FROM b LEFT JOIN u USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM d QUALIFY rank <= 2000""",
}
