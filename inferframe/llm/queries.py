"""Queries of this subpackage over the supplied tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align_tokenizers
from .bm25 import bm25_top_k
from .bpe import bpe_decode, bpe_encode, read_ranks
from .decontaminate import decontaminate
from .fingerprints import fingerprint_edits
from .langid import identify_languages, page_declared, page_text
from .line_dedup import line_dedup
from .ngram_lm import lm_scores
from .phrases import collocations
from .quality import quality_scores
from .simhash import simhash_components
from .substring_dedup import substring_dedup
from .url_filter import BIAS, DIMS, RULES, host_and_path, train_plain, url_verdicts

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents; fewer files than cores (small tables only) are dealt out to all cores."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def op1_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100, whole texts on both sides."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bm25_top_k(docs, docs.where(F.col("doc_id") % 100 == 0), k=10)


OP1_SQL = f"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM documents
), p AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT documents.doc_id, count(t) AS n FROM documents LEFT JOIN w USING (doc_id) GROUP BY ALL),
c AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM l),
i AS (SELECT t, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, c GROUP BY t),
s AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(q.tf * idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM p AS q JOIN i USING (t) JOIN p USING (t) JOIN l ON l.doc_id = p.doc_id, c
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, p.doc_id
)
SELECT query_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s) WHERE rank <= 10
"""


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a bigram model of nine in ten of them."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    return lm_scores(docs, held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text, declared language and source."""
    docs = documents(spark, sf_dir)
    return identify_languages(docs, declared=F.col("lang"), host=F.col("source")).withColumnRenamed("id", "doc_id")


def op3_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its text, markup, address suffix and host."""
    pages = table(spark, sf_dir, "pages").withColumn("text", page_text(F.col("html")))
    return identify_languages(pages, "page_id", declared=page_declared(F.col("html")), host=host_and_path(F.col("url"))[0]).withColumnRenamed("id", "page_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    out = simhash_components(documents(spark, sf_dir), shingle=4, seed=42, max_distance=4)
    return out.withColumnRenamed("id", "doc_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a window of 35 words that also starts anywhere else go."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup(docs, length=35, derive={"kept_sha256": lambda kept: F.sha2(kept, 256)}, keep_text=False).drop("spans")


_ALL_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_ALL_WORDS} AS ws FROM documents),
w AS (
  SELECT doc_id, a, md5(array_to_string(ws[a:a + 34], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS a FROM d WHERE len(ws) >= 35)
), r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(a, a + 35)) AS pos FROM w JOIN r USING (k)),
x AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM d)
SELECT d.doc_id, CAST(any_value(len(ws)) AS BIGINT) AS n_words, count(g.pos) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY x.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN g ON g.doc_id = x.doc_id AND g.pos = x.pos GROUP BY d.doc_id
"""


def bpe_columns(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of each text."""
    out = bpe_encode(docs, ranks_path, pattern, text_col)
    decoded = bpe_decode(F.col("ids"), read_ranks(ranks_path))
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return out.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(joined, 256), "decoded_sha256": F.sha2(decoded, 256)}).drop("ids")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text with the public 50k byte-level vocabulary."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe_columns(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality votes of the nearest labelled documents, learned from two of three folds."""
    return quality_scores(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rule or by logistic regression."""
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_sql() -> str:
    def frame(text: str, start: int) -> str:
        code = " + ".join(f"unicode(substr({text}, CAST(i AS INT) + {k}, 1)) * {m}" for k, m in enumerate((961, 31, 1)))
        return f"list_transform(range(1, length({text}) - 1), lambda i: ({code} + {start * 7}) % {DIMS} + {start})"

    def case(column: int) -> str:
        whens = []
        for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
            cut = rule[1].index("/")
            host, path = rule[1][:cut], rule[1][cut:]
            whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{rule[column]}'")
        return "CASE " + " ".join(whens) + " END"

    return f"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), f AS (SELECT *, '^' || host || '$' AS fh, '^' || path || '$' AS fp FROM p),
g AS (SELECT *, list_concat({frame("fh", 0)}, {frame("fp", DIMS)}) AS g FROM f),
m AS (SELECT {train_plain()} AS w),
s AS (SELECT g.*, coalesce(list_sum(list_transform(g, lambda j: w[j + 1] * {BIAS})), 0) + w[{2 * DIMS + 1}] * len(g) AS margin FROM g, m)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN margin > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more in 5 documents or more stay only in the largest doc_id."""
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, (s.k IS NOT NULL AND doc_id <> keeper) AS gone FROM keyed LEFT JOIN shared s ON keyed.k = s.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside any occurrence of a 13-word window of a benchmark item."""
    out = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=13, share=20)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[a:a + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS a FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, n, a, array_to_string(ws[a:a + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM p))
), m AS (SELECT doc_id, item_id, dw.n AS n, a FROM dw JOIN p ON dw.w = p.w AND dw.n = p.n),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS x FROM m) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited form, and how like it and the next document's they are."""
    return fingerprint_edits(documents(spark, sf_dir).select("doc_id", "text"), samples=128)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language: phrases of 2 to 5 words that occur 100 times or more."""
    return collocations(documents(spark, sf_dir).select("lang", "text"), min_count=100, share=100, top=2000)


OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
t AS (SELECT lang, sum(len(ws)) AS n FROM s GROUP BY lang),
g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM s, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m)
), f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, p.f AS l, q.f AS r, n, (1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f) AS score
  FROM cuts JOIN f AS p ON p.lang = cuts.lang AND p.phrase = x JOIN f AS q ON q.lang = cuts.lang AND q.phrase = y JOIN t ON t.lang = cuts.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, f AS longer, array_to_string(string_split(phrase, ' ')[b:b + size - 1], ' ') AS phrase
  FROM (SELECT lang, f, phrase, m, size, unnest(range(1, m - size + 2)) AS b FROM (SELECT *, unnest(range(2, m)) AS size FROM f WHERE m > 2))
), gone AS (SELECT DISTINCT best.lang, best.phrase FROM best JOIN inner_parts USING (lang, phrase) WHERE 100 * longer >= 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best ANTI JOIN gone USING (lang, phrase) QUALIFY rank <= 2000
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of a byte-level and of a piece vocabulary end together in every text, and how often their ids are linked so in all."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bm25_top_k": op1_bm25_top_k, "op2_lm_score": op2_lm_score, "op3_language_id": op3_language_id, "op3_language_id_pages": op3_language_id_pages, "op4_simhash": op4_simhash, "op5_substring_dedup": op5_substring_dedup, "op6_quality": op6_quality, "op7_bpe": op7_bpe, "op8_url_filter": op8_url_filter, "op9_line_dedup": op9_line_dedup, "op10_decontaminate": op10_decontaminate, "op11_fingerprints": op11_fingerprints, "op12_collocations": op12_collocations, "op13_token_alignment": op13_token_alignment}
ORACLE_SQL: dict[str, str] = {"op1_bm25_top_k": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op8_url_filter": op8_sql(), "op9_line_dedup": OP9_SQL, "op10_decontaminate": OP10_SQL, "op12_collocations": OP12_SQL}
