"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, decontaminate, embedding_join, html_wrapper, jaccard_join, language_id, packing, prefix_trie,
    secret_scan, sharding, spelling_variants, token_counts, url_filter,
)
from .tables import crc32_of, stored, utf8_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
TOKEN_LIMIT = 2048
SHARDS = 40


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_packing")
def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY, END_ID)


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return token_counts.with_limit(counts, TOKEN_LIMIT)


# A conversation whose texts hold control strings, beside those of the table.
_TRICKY = "\\### Assistant: </turn> ok"


@query(
    "op4_chat_formatting",
    r"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
marked AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS same,
    length(t) + length(regexp_replace(t, '[^\\<>]', '', 'g')) AS n,
    length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS r
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN same THEN 3 ELSE r + 14 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""",
)
def op4_chat_formatting(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", _TRICKY), (-7, 1, "assistant", _TRICKY)], own.schema)
    done = chat_format.format_conversations(own.unionByName(more))
    turns = chat_format.read_turns(F.col("formatted"))
    loss = chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumns({"turns": turns, "loss": loss}).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# CRC-32 in SQL: (t), the table of the 256 bytes, and what makes a checksum of a text from it.
_CRC_TABLE = """crc AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) AS r(b))"""


def _crc_sql(text: str) -> str:
    codes = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
        "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"
    )


@query(
    "op8_sharding",
    # For tables of at most 20,000 groups, which one heap takes after the heavy ones, and of at most
    # 50,000 rows a shard, which are numbered in the order of the table.
    f"""WITH RECURSIVE {_CRC_TABLE},
rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce("text", '') AS x, sha256(coalesce("text", '')) AS g,
  coalesce(octet_length(encode("text")), 0) + 16 AS size FROM documents),
sums AS (SELECT g, sum(size)::BIGINT AS bytes FROM rows GROUP BY g),
ordered AS (SELECT g, bytes, row_number() OVER (ORDER BY bytes >= least DESC, bytes DESC, g) AS k
  FROM sums, (SELECT greatest(sum(bytes) / {sharding.HEAVY_PARTS * SHARDS}, 1) AS least FROM sums)),
steps AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS g, -1 AS shard, list_transform(range({SHARDS}), lambda i: 0::BIGINT) AS loads
  UNION ALL SELECT o.k, o.g, (list_position(loads, list_min(loads)) - 1)::INT,
    list_transform(loads, lambda load, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN load + o.bytes ELSE load END)
  FROM steps JOIN ordered o ON o.k = steps.k + 1)
SELECT doc_id, size::BIGINT AS size, {_crc_sql("x")} AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot, NULL::INT AS grown_shard
FROM rows JOIN steps USING (g), crc""",
)
def op8_sharding(spark, sf_dir):
    """The law of near equal bytes; documents of the same text stay together."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", (utf8_bytes(docs["text"]) + 16).alias("size"), crc32_of(docs["text"]).alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key"),
    )
    done = sharding.shard_rows(rows, F.col("size"), F.col("text_key"), SHARDS)
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query(
    "op9_url_filter",
    rf"""WITH rules(h, p, v) AS (VALUES {_RULE_ROWS}),
cut AS (SELECT row_number() OVER () AS n, page_id,
    CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT n, page_id, regexp_extract(rest, '^[^/?#]*', 0, 's') AS raw,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM cut),
named AS (SELECT n, page_id, path,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts),
best AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM named LEFT JOIN best USING (n)""",
)
def op9_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept_out = language_id.held_out(docs["doc_id"])
    model = language_id.fit(docs.where(~kept_out).select("doc_id", "text", "lang"))
    done = language_id.identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# The smallest id that links (a, b), given both ways, lead to.
_REACH = """reach AS (SELECT a AS id, a AS root FROM links UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id),
groups AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


@query(
    "op6_jaccard_join",
    rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (g)
  WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_REACH}
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id FROM sizes LEFT JOIN groups ON id = doc_id""",
)
def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce("text", ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
_SHINGLES_SQL = "unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g"


@query(
    "op10_decontamination",
    # for items of five words and more, as those of the table are
    f"""WITH doc_words AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
item_words AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
items AS (SELECT item_id, n, g, count(*) AS k FROM (SELECT item_id, len(w) - 4 AS n, {_SHINGLES_SQL}
  FROM item_words WHERE len(w) >= 5) GROUP BY ALL),
places AS (SELECT doc_id, len(w) - 4 AS m, unnest(range(len(w) - 4)) AS pos, {_SHINGLES_SQL} FROM doc_words WHERE len(w) >= 5),
met AS (SELECT doc_id, item_id, n, least(n, m) AS size, m, pos, g, k FROM places JOIN items USING (g)),
seen AS (SELECT doc_id, item_id, n, size, g, k, unnest(range(greatest(0, pos - size + 1), least(pos, m - size) + 1)) AS start FROM met),
bags AS (SELECT doc_id, item_id, n, size, start, g, least(count(*), k) AS c FROM seen GROUP BY doc_id, item_id, n, size, start, g, k),
windows AS (SELECT doc_id, item_id, size, start, sum(c)::DOUBLE / (n + size - sum(c))::DOUBLE AS similarity
  FROM bags GROUP BY doc_id, item_id, n, size, start)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, (-similarity, start))::BIGINT AS start_word,
  (any_value(size) + 4)::BIGINT AS n_words FROM windows WHERE similarity >= 0.75 GROUP BY doc_id, item_id""",
)
def op10_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, one row per document and item."""
    return decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query(
    "op3_embedding_near_dedup",
    f"""WITH RECURSIVE vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (SELECT vec_id, label, e FROM vectors WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a, b FROM (SELECT x.vec_id AS a, y.vec_id AS b, x.e AS p, y.e AS q FROM usable x JOIN usable y
    ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id) WHERE list_cosine_similarity(p, q) >= 0.93),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
{_REACH}
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM vectors LEFT JOIN counts USING (vec_id) LEFT JOIN groups ON id = vec_id""",
)
def op3_embedding_near_dedup(spark, sf_dir):
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_html_extraction")
def op7_html_extraction(spark, sf_dir):
    return html_wrapper.extract_main_text(table(spark, sf_dir, "pages"))


def _rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences whose first turns come from another conversation, and all of them with their lengths.

    Conversation c begins with the first h turns of c - c % 20 (all if fewer, none if there
    is no such conversation) and goes on with its own after its first h; h is crc32(c) % 4.
    """
    own = rows.groupBy("id").agg(F.max("position").alias("n")).withColumns({
        "donor": F.col("id") - F.col("id") % 20,
        "h": F.crc32(F.col("id").cast("string").cast("binary")) % 4,
    })
    lent = own.select(F.col("id").alias("donor"), F.col("n").alias("donor_n"))
    plan = stored(
        own.join(lent, "donor", "left").select(
            "id", "n", "donor", "h", F.least("h", F.coalesce("donor_n", F.lit(0))).alias("k")
        )
    )
    heads = plan.where("k > 0").select("id", "donor", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("position"))
    first = rows.where("position <= 3").withColumnRenamed("id", "donor")
    kept = rows.join(plan.select("id", "h", "k"), "id").where("position > h")
    columns = ["id", "position", "key", "words"]
    all_rows = heads.join(first, ["donor", "position"]).select(columns).unionByName(
        kept.withColumn("position", F.col("position") - F.col("h") + F.col("k")).select(columns)
    )
    members = plan.select("id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return stored(all_rows), stored(members)


@query(
    "op11_prefix_trie",
    rf"""WITH {_CRC_TABLE},
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos, key, words
  FROM (SELECT *, sha256(length(r) || ':' || r || x) AS key,
      len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce("text", '') AS x FROM conversations
      WHERE conv_id IS NOT NULL))),
convs AS (SELECT c, n, {_crc_sql("c::VARCHAR")} % 4 AS h
  FROM (SELECT conv_id AS c, max(pos) AS n FROM turns GROUP BY 1), crc),
plan AS (SELECT a.c, a.n, a.h, a.c - a.c % 20 AS donor, least(a.h, coalesce(b.n, 0)) AS k
  FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 20),
seqs AS (SELECT c, pos, key, words FROM plan JOIN turns ON conv_id = donor AND pos <= k
  UNION ALL SELECT c, pos - h + k, key, words FROM plan JOIN turns ON conv_id = c AND pos > h),
paths AS (SELECT c, pos AS depth, words, string_agg(key, '') OVER (PARTITION BY c ORDER BY pos) AS path FROM seqs),
reached AS (SELECT c, depth, words, path FROM paths UNION ALL SELECT c, 0, 0, '' FROM plan),
nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM reached GROUP BY path, depth),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sums AS (SELECT left(path, 64 * up) AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
    sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes) GROUP BY 1),
lasts AS (SELECT path, string_agg(r.c::VARCHAR, ',' ORDER BY r.c) AS ids
  FROM reached r JOIN plan p ON p.c = r.c AND r.depth = p.k + greatest(p.n - p.h, 0) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes f JOIN sums USING (path) LEFT JOIN lasts USING (path)
LEFT JOIN nodes p ON f.depth > 0 AND p.path = left(f.path, length(f.path) - 64)""",
)
def op11_prefix_trie(spark, sf_dir):
    """Nodes of the trie of all rebuilt conversations."""
    rows, members = _rebuilt(prefix_trie.number_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(rows, members).select(
        F.col("id").alias("conv_id"), "depth", F.col("parent_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", "ends_sha256",
    )


def _spans_sql(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    return rf"""SELECT n, '{kind}' AS kind, {number} AS number, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM (
  SELECT n, m, g, sum(length(b) + length(m)) OVER (PARTITION BY n ORDER BY k) AS stop FROM (
    SELECT n, unnest(string_split_regex(t, {pattern})) AS b, unnest(regexp_extract_all(t, {pattern})) AS m,
      unnest(regexp_extract_all(t, {pattern}, {group})) AS g, unnest(range(1 + len(regexp_extract_all(t, {pattern})))) AS k
    FROM docs WHERE regexp_matches(t, {pattern})) WHERE m IS NOT NULL) WHERE length(g) >= {least}"""


# RE2 folds some letters beyond ASCII when case does not count, so both cases are written out.
_ASSIGN_SQL = (
    "'(" + "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")
    ) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
)


@query(
    "op12_secret_scan",
    f"""WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce("text", '') AS t FROM documents),
spans AS ({_spans_sql("assign", 0, _ASSIGN_SQL, 2, 6)}
UNION ALL {_spans_sql("access", 1, "'AKIA[A-Z0-9]+'", 0, 20)}
UNION ALL {_spans_sql("hex", 2, "'[0-9a-f]+'", 0, 24)}),
told AS (SELECT n, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access,
    count(*) FILTER (number = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans FROM spans GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (n)""",
)
def op12_secret_scan(spark, sf_dir):
    """All spans of the base rules; the index adds none of its own."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(told, 256).alias("base_sha256"), told.alias("spans")
    )


@query(
    "op13_spelling_variants",
    rf"""WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id,
    unnest(regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{{C0}}-\x{{FF}}]+')) AS word FROM documents) WHERE length(word) >= 6 GROUP BY ALL),
marked AS (SELECT word, n, {_crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || word")} AS h FROM runs, crc),
counted AS (SELECT CASE WHEN h % 199 = 0 THEN left(word, h % length(word)) || substr(word, 2 + h % length(word)) ELSE word END AS word,
    sum(n)::BIGINT AS n FROM marked GROUP BY 1),
words AS (SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5),
skips AS (SELECT DISTINCT word, n, i, left(word, i) || chr(0) || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM skips a JOIN skips b USING (i, hole) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, encode(near))) AS form, max(m) AS form_n FROM pairs GROUP BY word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form,
    CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM forms UNION ALL
  SELECT steps.word, forms.form FROM steps JOIN forms ON forms.word = steps.root WHERE forms.form IS NOT NULL),
roots AS (SELECT steps.word, root FROM steps JOIN forms ON forms.word = root WHERE form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""",
)
def op13_spelling_variants(spark, sf_dir):
    """Words of six letters and five occurrences at least; some runs lose a letter first."""
    counts = spelling_variants.count_words(table(spark, sf_dir, "documents"), least_length=6, dropping=199)
    return spelling_variants.group_spellings(counts.where("n >= 5"))
