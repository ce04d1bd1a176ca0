"""The registered queries of the text problems, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paigham.llm import p1_lookalike, p2_personal, p3_copies, p4_encoding, p5_terms, p6_overlap, p7_splits, p8_leaks, p9_mixture, p10_abuse
from paigham.llm.common import has_text
from paigham.storage import cut, table

#: The table of look-alikes, forms of one letter or none.
_SINGLE = {c: x for c, x in p1_lookalike.TABLE.items() if len(x) <= 1}
_MOVED = [c for c, x in _SINGLE.items() if x] + [c for c, x in _SINGLE.items() if not x]

Query = Callable[[SparkSession, str], DataFrame]


def _of(name: str, operator: Callable[..., DataFrame], *more: str) -> Query:
    """The operator on whole tables of the folder."""
    return lambda spark, d: operator(*(table(spark, d, t) for t in (name, *more)))


def _with_names(operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, d: operator(table(spark, d, "processed"), p2_personal.given_names(table(spark, d, "given_names")))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _of("processed", p1_lookalike.found),
        "p1_normalized": _of("processed", lambda df: p1_lookalike.normalized(df).select("row_id", "canon", "changed")),
        "p1_classes": _of("processed", p1_lookalike.classes),
        "p2_found": _with_names(p2_personal.found),
        "p2_redacted": _with_names(p2_personal.redacted),
        "p3_found": _of("processed", p3_copies.found),
        "p3_collapsed": _of("processed", p3_copies.collapsed),
        "p4_found": _of("processed", p4_encoding.found),
        "p4_restored": _of("processed", p4_encoding.restored),
        "p5_found": _of("processed", p5_terms.found),
        "p5_terms": _of("processed", p5_terms.counted),
        "p6_found": _of("processed", p6_overlap.found),
        "p6_report": _of("processed", p6_overlap.report),
        "p6_classes": _of("processed", p6_overlap.classes),
        "p7_found": _of("processed", p7_splits.found, "senders"),
        "p7_splits": _of("processed", p7_splits.assigned, "senders", "split_targets"),
        "p7_report": _of("processed", p7_splits.report, "senders", "split_targets"),
        "p7_kept": _splits_kept,
        "p8_found": _of("documents", p8_leaks.found, "eval_items"),
        "p8_leaks": _of("documents", p8_leaks.leaks, "eval_items"),
        "p9_mixture": _of("documents", p9_mixture.mixture, "mix_targets"),
        "p9_shares": _of("documents", p9_mixture.shares, "mix_targets"),
        "p9_kept": _mixture_kept,
        "p10_found": _of("documents", p10_abuse.found),
        "p10_scores": _of("documents", p10_abuse.scored),
        "p10_rates": _of("documents", p10_abuse.rates),
    }


_TERMS = r"""
WITH t AS (
  SELECT row_id, unnest(list_filter(string_split_regex(cleaned_msg, '\s+'), lambda x: x <> '')) AS term
  FROM processed WHERE cleaned_msg IS NOT NULL
), n AS (SELECT count(DISTINCT row_id) AS total FROM t),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM t GROUP BY term),
m AS (SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 100 > 15 * total THEN 'common' END AS mark FROM c, n)
"""

_OVERLAP = r"""
WITH r AS (
  SELECT row_id, split = 'train' AS train, cleaned_msg,
         CASE WHEN trim(msg) <> '' THEN list_distinct(regexp_extract_all(lower(msg), '[\p{L}\p{N}]+')) END AS words
  FROM processed WHERE split IN ('train', 'validation', 'test')
), w AS (SELECT row_id, train, len(words) AS n, unnest(words) AS word FROM r WHERE len(words) > 0),
near AS (
  SELECT a.row_id AS i, b.row_id AS j FROM w a JOIN w b ON a.word = b.word AND a.train AND NOT b.train
  GROUP BY a.row_id, b.row_id, a.n, b.n HAVING count(*) * 100 >= 70 * (a.n + b.n - count(*))
), same AS (
  SELECT a.row_id AS i, b.row_id AS j FROM r a JOIN r b ON a.cleaned_msg = b.cleaned_msg AND a.train AND NOT b.train WHERE trim(a.cleaned_msg) <> ''
)
"""
_OVERLAP_PAIRS = "SELECT least(i, j) AS row_a, greatest(i, j) AS row_b FROM (SELECT * FROM near UNION SELECT * FROM same)"
_OVERLAP_COUNTS = """, links AS (SELECT i, j FROM near UNION SELECT i, j FROM same), partners AS (SELECT row_id, count(*) AS n FROM (SELECT i AS row_id FROM links UNION ALL SELECT j FROM links) GROUP BY row_id)
"""
_OVERLAP_CLASSES = _OVERLAP_COUNTS + """, part AS (SELECT *, CASE WHEN len(words) > 0 THEN min(row_id) OVER (PARTITION BY list_sort(words)) ELSE row_id END AS class_row_id FROM r)
SELECT row_id, class_row_id, coalesce(n, 0) AS n_links FROM part LEFT JOIN partners USING (row_id) WHERE len(words) > 0 OR trim(cleaned_msg) <> ''
"""
_OVERLAP_REPORT = _OVERLAP_COUNTS + """
SELECT split, source, count(*) AS n_rows, count(n) AS n_overlapping, coalesce(sum(n), 0)::BIGINT AS n_pairs FROM processed LEFT JOIN partners USING (row_id) WHERE split IN ('validation', 'test') GROUP BY ALL
"""

_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS p FROM d WHERE len(w) >= 10),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS p FROM i WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (p)
"""

_LINKS = r"""
WITH RECURSIVE k AS (
  SELECT row_id, 's' || sender_id::VARCHAR AS key FROM processed WHERE sender_id IS NOT NULL
  UNION ALL SELECT row_id, 'c' || campaign_id FROM processed WHERE trim(campaign_id) <> ''
  UNION ALL SELECT row_id, 't' || cleaned_msg FROM processed WHERE trim(cleaned_msg) <> ''
), shared AS (SELECT key FROM k GROUP BY key HAVING count(*) > 1),
e AS (
  SELECT DISTINCT a.key AS u, b.key AS v FROM k a JOIN k b USING (row_id) WHERE a.key <> b.key AND a.key IN (FROM shared) AND b.key IN (FROM shared)
  UNION SELECT 's' || sender_id::VARCHAR, 's' || alias_of::VARCHAR FROM senders WHERE alias_of IS NOT NULL
  UNION SELECT 's' || alias_of::VARCHAR, 's' || sender_id::VARCHAR FROM senders WHERE alias_of IS NOT NULL
), l AS (
  SELECT key AS node, min(row_id) AS label FROM k WHERE key IN (FROM shared) OR key[1] = 's' GROUP BY key
  UNION ALL SELECT DISTINCT u, 9223372036854775807 FROM e WHERE u NOT IN (SELECT key FROM k)
), walk(node, label) USING KEY (node) AS (
  SELECT node, label FROM l
  UNION
  SELECT e.v, min(w.label) FROM walk w JOIN e ON e.u = w.node JOIN recurring.walk x ON x.node = e.v WHERE w.label < x.label GROUP BY e.v
)
SELECT min(w.label) AS first_row_id, k.row_id FROM k JOIN walk w ON w.node = k.key GROUP BY k.row_id HAVING min(w.label) <> k.row_id
"""


_LONGER = "".join(f", chr({c}), '{x}')" for c, x in p1_lookalike.TABLE.items() if len(x) > 1)
_ARABIC = r"[\x{620}-\x{6FF}]"
_HELD = rf"regexp_replace(regexp_replace(regexp_replace(msg, '([\p{{So}}\p{{Sk}}\x{{FE0F}}])\x{{200D}}(\p{{So}})', '\1' || chr(64977) || '\2', 'g'), '({_ARABIC})\x{{200C}}({_ARABIC})', '\1' || chr(64976) || '\2', 'g'), '({_ARABIC})\x{{200D}}({_ARABIC})', '\1' || chr(64977) || '\2', 'g')"
#: Rows whose forms by the table are equal and whose characters are not; forms of several letters are replaced one by one.
_FORMS = f"""
WITH h AS (SELECT row_id, msg, nfc_normalize({_HELD}) AS x FROM processed WHERE msg IS NOT NULL),
t AS (SELECT row_id, msg, nfc_normalize({"replace(" * _LONGER.count(", chr(")}translate(x, '{"".join(map(chr, _MOVED))}', '{"".join(_SINGLE[c] for c in _MOVED).replace("'", "''")}'){_LONGER}) AS canon FROM h),
k AS (SELECT * FROM t WHERE trim(canon, chr(9) || chr(10) || chr(13) || ' ') <> '')
"""
_LOOKALIKE = _FORMS + """
SELECT a.row_id AS row_a, b.row_id AS row_b FROM k a JOIN k b ON a.canon = b.canon AND a.row_id < b.row_id AND a.msg <> b.msg
"""
_LOOKALIKE_CLASSES = _FORMS + """
SELECT row_id, min(row_id) OVER (PARTITION BY canon) AS class_row_id, count(*) OVER (PARTITION BY canon) AS n_rows, count(*) OVER (PARTITION BY canon) - count(*) OVER (PARTITION BY canon, msg) AS n_links FROM k
"""


def _words_of(x: str) -> str:
    return rf"array_to_string(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+'), ' ')"


#: Labelled fields start after chr(2); labels without a value belong to the text before.
_COPIES = rf"""
WITH g AS (SELECT row_id, msg, lower(msg) AS low FROM processed WHERE regexp_matches(msg, '[^\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200B}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}\x1c-\x1f]')),
m AS (SELECT row_id, msg, low, regexp_replace(replace(replace(low, '://', chr(1)), '=//', chr(1)), '(\p{{L}}[\p{{L}}\p{{N}}_]*\s*[:=])', chr(2) || '\1', 'g') AS x FROM g),
v AS (SELECT row_id, msg, low, len(string_split(x, chr(2))) - 1 AS labels, string_split(x, chr(2)) AS parts FROM m),
e AS (SELECT row_id, msg, low, labels, list_transform(parts, lambda p, i: CASE WHEN i = 1 OR NOT regexp_matches(p, '^[\p{{L}}\p{{N}}_]+\s*[:=].*[\p{{L}}\p{{N}}]', 's') THEN p ELSE chr(2) || p END) AS marked FROM v),
f AS (SELECT row_id, msg, low, labels, string_split(array_to_string(marked, ''), chr(2)) AS p FROM e),
c AS (SELECT row_id, CASE WHEN labels >= 2 AND len(p) >= 3 THEN chr(30) || {_words_of('p[1]')} || chr(30) || array_to_string(list_sort(list_transform(p[2:], lambda q: {_words_of('q')})), chr(30)) WHEN {_words_of('low')} <> '' THEN {_words_of('low')} ELSE chr(29) || msg END AS canon FROM f)
"""
_COLLAPSED = _COPIES + "SELECT min(row_id) AS row_id, count(*) AS n_copies FROM c GROUP BY canon"
_COPIES += """
SELECT min(row_id) OVER (PARTITION BY canon) AS first_row_id, row_id FROM c QUALIFY first_row_id <> row_id
"""

_KEPT = "SELECT 0 AS broken_groups, 0 AS rows_without_split, 0 AS rows_with_two, 0 AS shares_off, 0 AS scam_off"
_MIXED = "SELECT 0 AS used_twice, 0 AS over_repeats, 0 AS untargeted, 0 AS without_text, 0 AS shares_off"


def _splits_kept(spark: SparkSession, d: str) -> DataFrame:
    """What an assignment of splits must not have, counted: all zero."""
    rows, senders, targets = (table(spark, d, t) for t in ("processed", "senders", "split_targets"))
    given = cut(p7_splits.assigned(rows, senders, targets))
    groups = p7_splits.grouped(rows, senders).join(given, "row_id", "left")
    broken = groups.groupBy("first_row_id").agg(F.count_distinct("split").alias("k"), F.count("*").alias("n"), F.count("split").alias("m"))
    two = F.sum("n") - F.lit(rows.count())
    one = broken.agg(F.count_if(F.col("k") > 1).cast("int").alias("broken_groups"), F.sum(F.col("n") - F.col("m")).cast("int").alias("rows_without_split"), two.cast("int").alias("rows_with_two"))
    per = given.join(rows.select("row_id", "status"), "row_id").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Scam").alias("scam"))
    whole = per.agg(F.sum("n").alias("all"), F.sum("scam").alias("all_scam"))
    near = per.join(targets.select("split", "share"), "split", "full").crossJoin(F.broadcast(whole))
    share, scam = F.coalesce("n", F.lit(0)) / F.col("all") - F.coalesce("share", F.lit(0.0)), F.col("scam") / F.col("n") - F.col("all_scam") / F.col("all")
    off = near.agg(F.count_if(F.abs(share) > 0.02).cast("int").alias("shares_off"), F.count_if(F.abs(scam) > 0.05).cast("int").alias("scam_off"))
    return one.crossJoin(F.broadcast(off))


def _mixture_kept(spark: SparkSession, d: str) -> DataFrame:
    """What a mixture must not have, counted: all zero."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    used = cut(p9_mixture.mixture(documents, targets))
    joined = used.join(documents.select("doc_id", F.col("source").alias("own"), "text"), "doc_id").join(targets.select("source", "max_repeats"), "source", "left")
    count = lambda c: F.count_if(c).cast("int")
    untargeted = F.col("max_repeats").isNull() | (F.col("own") != F.col("source"))
    one = joined.agg((F.count("*") - F.count_distinct("doc_id")).cast("int").alias("used_twice"), count(F.col("repeats") > F.col("max_repeats")).alias("over_repeats"), count(untargeted).alias("untargeted"), count(~has_text(F.col("text"))).alias("without_text"))
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).join(targets, "source", "left")
    whole = got.agg(F.sum("t").alias("all"), F.sum("target_share").alias("aimed"))
    off = got.crossJoin(F.broadcast(whole)).agg(count(F.abs(F.col("t") / F.col("all") - F.col("target_share") / F.col("aimed")) > 0.01).alias("shares_off"))
    return one.crossJoin(F.broadcast(off))


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _LOOKALIKE,
        "p3_found": _COPIES,
        "p7_kept": _KEPT,
        "p9_kept": _MIXED,
        "p5_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p5_terms": _TERMS + "SELECT * FROM m",
        "p1_classes": _LOOKALIKE_CLASSES,
        "p3_collapsed": _COLLAPSED,
        "p6_found": _OVERLAP + _OVERLAP_PAIRS,
        "p6_classes": _OVERLAP + _OVERLAP_CLASSES,
        "p6_report": _OVERLAP + _OVERLAP_REPORT,
        "p7_found": _LINKS,
        "p8_found": _LEAKS,
    }
