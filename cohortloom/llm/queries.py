"""The queries of the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, exact_dedup, hard_negatives, licenses, line_dedup, quality, rule_ledger, secrets, sentencepiece, simhash, spelling, substrings, token_files
from .common import read


def tokenizer_file(name: str) -> str:
    """The place of a vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3)


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"), length=50)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.known(spark, licenses.more_texts()), licenses.known(spark, licenses.more_notices()))


def _license_sql() -> str:
    """The same texts, notices and rules in DuckDB."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"

    def is_statement(line: str) -> str:
        """Whether a line of lower case is a copyright statement: the rule of the operator, whose look-aheads are tests of their own here."""
        m = lambda p: f"regexp_matches({line}, {quoted('^[ \\t\\f\\v\\r]*' + p)})"
        year = f"regexp_matches({line}, {quoted('\\b(19|20)[0-9][0-9]\\b')})"
        after = f"regexp_matches({line}, {quoted('^[ \\t\\f\\v\\r]*copyright[ :]*(by|the)\\b.*\\b(19|20)[0-9][0-9]\\b')})"
        named = f"(NOT {m('copyright[ :]*(' + licenses._PROSE + ')' + chr(92) + 'b')} AND {m('copyright[ :]*[' + chr(92) + 'p{L}<' + chr(92) + '[{]')})"
        signed = m("copyright[ :]*(" + chr(92) + "(c" + chr(92) + ")|©|[0-9])")
        first = f"{m('copyright[ :(]')} AND NOT {m('copyright[ :]*(notices?|holders?|owners?|ownership)' + chr(92) + 'b')} AND ({signed} OR {after} OR {named})"
        sign = chr(92) + "(c" + chr(92) + ")"
        return f"(({first}) OR {m(sign + '[ ' + chr(92) + 't' + chr(92) + 'f' + chr(92) + 'v' + chr(92) + 'r]*copyright')} OR ({m(sign)} AND {year}) OR {m('(©|all rights reserved)')})"

    def canonical(text: str) -> str:
        lines = f"array_to_string(list_transform(string_split(lower({text}), chr(10)), lambda x: CASE WHEN {is_statement('x')} THEN ' ' ELSE x END), chr(10))"
        out = f"' ' || trim(regexp_replace({lines}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
        for odd, usual in licenses.SPELLINGS.items():
            out = f"replace({out}, {quoted(' ' + odd)}, {quoted(' ' + usual)})"
        return f"trim({out})"

    def known(texts: list[tuple[str, str]]) -> str:
        rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in texts)
        return f"SELECT sha256({canonical('t')}) AS digest, min(i) AS license_id FROM (VALUES {rows}) AS v(i, t) GROUP BY 1"

    return f"""
WITH texts AS ({known(licenses.more_texts())}), notes AS ({known(licenses.more_notices())}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT r, doc_id, {canonical('text')} AS c FROM d),
l AS (SELECT DISTINCT r, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT r, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices FROM l JOIN notes ON digest = sha256({canonical('line')}) GROUP BY r)
SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS text_digest, license_id, coalesce(notices, '') AS notices
FROM c LEFT JOIN texts ON c <> '' AND texts.digest = sha256(c) LEFT JOIN n USING (r)
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=13)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


OP8_SQL = """
WITH g AS (SELECT coalesce(text, '') AS text, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(g.text) AS text_sha256
FROM documents d JOIN g ON g.text = coalesce(d.text, '')
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.quality_rules(read(spark, sf_dir, "documents"))


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.ablations(rule_ledger.ledger(read(spark, sf_dir, "documents")))


_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
t AS (SELECT r, pos, word, lead(word, 1) OVER x AS b, lead(word, 2) OVER x AS c FROM w WINDOW x AS (PARTITION BY r ORDER BY pos)),
g AS (SELECT r, pos, c IS NOT NULL AND count(*) OVER (PARTITION BY r, word, b, c) > 1 AS again, word FROM t),
h AS (SELECT r, word, again OR coalesce(lag(again, 1) OVER x, false) OR coalesce(lag(again, 2) OVER x, false) AS hit FROM g WINDOW x AS (PARTITION BY r ORDER BY pos)),
m AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (hit) AS n_repeat_words, sum(length(regexp_replace(word, '[^#*$%&|<>]', '', 'g'))) AS n_symbols FROM h GROUP BY r),
i AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•●▪]')) AS n_bullet_lines,
  count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipsis_lines FROM i WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
a AS (SELECT doc_id, COLUMNS(c -> c <> 'doc_id') FROM (SELECT d.doc_id, coalesce(m.n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(n_symbols, 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bullet_lines, 0)::BIGINT AS n_bullet_lines, coalesce(n_ellipsis_lines, 0)::BIGINT AS n_ellipsis_lines FROM d LEFT JOIN m USING (r) LEFT JOIN l USING (r))),
f AS (SELECT *, (%s)::BIGINT AS failures FROM a)
""".replace("COLUMNS(c -> c <> 'doc_id')", "* EXCLUDE (doc_id)").replace("%s", " | ".join(f"CASE WHEN {c} THEN {rule_ledger.rule_bit(r)} ELSE 0 END" for r, c in rule_ledger.RULES.items()))

OP11_SQL = _RULES_SQL + "SELECT *, failures & 3 <> 0 AS base_failed, failures = 0 AS kept FROM f"


def _ablation_sql() -> str:
    parts = []
    for p in rule_ledger.POLICIES:
        fatal, counted = rule_ledger.mask_of(p.fatal), rule_ledger.mask_of(p.counted)
        kept = lambda x: f"({x} & {fatal}) = 0 AND bit_count(({x} & {counted})) <= {p.allowed}"  # noqa: B023, E731
        for rule in dict.fromkeys([*p.fatal, *p.counted]):
            bit = rule_ledger.rule_bit(rule)
            parts.append(f"SELECT '{p.version}' AS version, '{rule}' AS rule, count(*) AS n_texts, count(*) FILTER (failures & {bit} <> 0) AS n_failed, count(*) FILTER ({kept('failures')}) AS n_kept, count(*) FILTER ({kept(f'(failures & {127 ^ bit})')}) AS n_kept_without FROM f")
    return _RULES_SQL + " UNION ALL ".join(parts)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(hard_negatives.integer_vectors(read(spark, sf_dir, "embeddings"), label, scale=256), F.col("id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"), min_chars=7, min_count=2, altered=31, ratio=10)


#: crc32 from its rule (a table of 256 numbers made by eight shifts each); near words by their deletions and by the word without one place.
OP13_SQL = r"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
o AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
u AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM o GROUP BY 1, 2),
x AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b FROM u),
h AS (SELECT run, n, xor(list_reduce(list_transform(range(len(b) // 2), lambda i: ('0x' || substr(b, 2 * i + 1, 2))::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) AS h FROM x, k),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
q AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS hole FROM c),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM q a JOIN q b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT q.word, q.n, w.word, w.n FROM q JOIN w ON q.less = w.word UNION SELECT w.word, w.n, q.word, q.n FROM q JOIN w ON q.less = w.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.*, (SELECT arg_max(root, step) FROM r WHERE r.word = f.word) AS root FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}
    return own | {"quality_rule_ablations": quality_rule_ablations}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op6_license_scan": _license_sql(), "op8_exact_dedup": OP8_SQL, "op11_quality_rules": OP11_SQL, "quality_rule_ablations": _ablation_sql(), "op12_hard_negatives": OP12_SQL, "op13_spelling_variants": OP13_SQL}
