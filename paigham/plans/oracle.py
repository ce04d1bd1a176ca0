"""SQL that DuckDB runs on the same tables, one statement per query."""

from __future__ import annotations

from paigham import lexicon
from paigham.functions import text as X

SP = X.SPACE
SET = X.SPACE_SET
STOP = sorted(lexicon.stopwords())


def _listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _case(x: str, mapping: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {other} END"


def _sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def strip(x: str) -> str:
    return _sub(x, f"^{SP}+|{SP}+$", "")


def key(x: str) -> str:
    return f"coalesce({_sub(f'lower({strip(x)})', f'{SP}+', ' ')}, 'nan')"


def label(x: str) -> str:
    return _case(f"lower({strip(x)})", lexicon.LABEL_SPELLINGS)


def source(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN {s} <> '' THEN {_case(f'lower({s})', lexicon.SOURCE_SPELLINGS, s)} END"


def missing_label(x: str) -> str:
    return f"({x} IS NULL OR lower({strip(x)}) IN ('', 'nan', 'none'))"


def urls(x: str) -> str:
    full = _sub(x, rf"(?i)(?:https?://|www\.)[^{SET}]+", lexicon.URL_TOKEN)
    ends = "|".join(lexicon.TOP_LEVEL_DOMAINS)
    # Word boundaries of any script; a boundary that one match takes is free again for the second pass.
    bare = rf"(?i)(^|[^\p{{L}}\p{{N}}_])[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.(?:{ends})(?:/[^{SET}]*|($|[^\p{{L}}\p{{N}}_/]))"
    by = rf"\1{lexicon.URL_TOKEN}\2"
    return _sub(_sub(full, bare, by), bare, by)


def numbers(x: str, other: str = lexicon.NUMBER_TOKEN, all_rules: bool = True) -> str:
    x = _sub(x, rf"(?i)\[{SP}*number{SP}*\]", lexicon.PHONE_TOKEN)
    if all_rules:
        x = _sub(x, rf"\*{SP}?\p{{Nd}}{{2,7}}{SP}?#", lexicon.SHORTCODE_TOKEN)
        x = _sub(x, rf"(?:\+?92|0)[{SET}-]?3\p{{Nd}}{{2}}[{SET}-]?\p{{Nd}}{{7}}\b|\b\p{{Nd}}{{11}}\b", lexicon.PHONE_TOKEN)
    digits = _sub("t", r"[^\p{Nd}]", "")
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{Nd}}[\\p{{Nd}},.]*|[^\\p{{Nd}}]+'), lambda t: CASE WHEN {digits} = '' THEN t WHEN {digits} IN {_listed(lexicon.SHORT_CODES)} THEN {digits} ELSE '{other}' END), '')"


def clean(x: str) -> str:
    c = numbers(urls(f"lower(coalesce({x}, ''))"))
    c = _sub(c, rf"[^\p{{L}}\p{{N}}_{SET}]|_", " ")
    c = _sub(c, rf"[^a-z0-9{SET}]", " ")
    return _sub(_sub(c, f"{SP}+", " "), "^ | $", "")


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SP}+'), lambda t: t <> '')"


def spelling(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda t: {_case('t', lexicon.SPELLINGS, 't')}), '')"


def stopped(parts: str) -> str:
    return f"list_filter({parts}, lambda t: t IN {_listed(sorted(lexicon.PROTECTED))} OR (t NOT IN {_listed(STOP)} AND length(t) >= 2))"


def preprocess(x: str) -> str:
    return f"array_to_string({stopped(tokens(spelling(clean(x))))}, ' ')"


def risk(x: str) -> str:
    hit = lambda words: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"
    return " + ".join(f"CASE WHEN {hit(words)} THEN 20 ELSE 0 END" for words in lexicon.RISK_KEYWORDS.values())


def level(score: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in lexicon.RISK_LEVELS) + f"][CAST(least(floor(({score}) / 25.0), 4) AS INT) + 1]"


def expected(x: str) -> str:
    return "CASE WHEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in lexicon.EXPECTED_SCAM_WORDS) + " THEN 'Scam' ELSE 'Genuine' END"


MICROS = "CASE WHEN regexp_matches(scanned_at, '(?:[Zz]|[+-]\\d{2}:?\\d{2})$') THEN epoch_us(TRY_CAST(scanned_at AS TIMESTAMPTZ)) ELSE epoch_us(TRY_CAST(scanned_at AS TIMESTAMP)) END"
RAW = "raw AS (SELECT raw_id AS row_id, msg, status, source FROM raw_messages)"
LABELLED = f"{RAW}, labelled AS (SELECT row_id, msg, {label('status')} AS status, {source('source')} AS source FROM raw)"
VALID = f"{LABELLED}, valid AS (SELECT *, {key('msg')} AS k FROM labelled WHERE msg IS NOT NULL AND {strip('msg')} <> '' AND status IS NOT NULL)"
GROUPS = f"{VALID}, groups AS (SELECT k, min(row_id) AS f, count(*) AS n, coalesce(min(status) <> max(status), false) AS clash FROM valid GROUP BY k)"
WORDS = f"words AS (SELECT status, word, count(*) AS n FROM (SELECT status, unnest({tokens('cleaned_msg')}) AS word FROM processed WHERE status IS NOT NULL AND cleaned_msg IS NOT NULL) GROUP BY status, word)"
TOP = f"{WORDS}, ranked AS (SELECT status, word, n, CAST(row_number() OVER (PARTITION BY status ORDER BY n DESC, word) AS INT) AS rank FROM words)"
TERMS = f"""docs AS (SELECT row_id, status, split, list_filter({tokens('cleaned_msg')}, lambda t: length(t) >= 2) AS t FROM processed WHERE cleaned_msg IS NOT NULL),
grams AS (SELECT row_id, status, split, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM docs),
tf AS (SELECT row_id, status, split, term, count(*) AS tf FROM grams GROUP BY ALL)"""
FITTED = f"""{TERMS}, size AS (SELECT count(*) AS n FROM docs WHERE split = 'train'),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total, ln((max(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf, size WHERE split = 'train' GROUP BY term),
raw_w AS (SELECT row_id, status, split, term, (ln(tf) + 1) * idf AS w FROM tf JOIN vocab USING (term)),
weights AS (SELECT row_id, status, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS weight FROM raw_w WHERE split IN ('train', 'test'))"""
BAYES = f"""{FITTED},
sums AS (SELECT term, sum(CASE WHEN status = 'Genuine' THEN weight ELSE 0 END) AS g, sum(CASE WHEN status = 'Scam' THEN weight ELSE 0 END) AS s FROM weights WHERE split = 'train' GROUP BY term),
totals AS (SELECT count(*) AS v, sum(g) AS tg, sum(s) AS ts FROM sums),
theta AS (SELECT term, ln((g + 1) / (tg + v)) AS theta_genuine, ln((s + 1) / (ts + v)) AS theta_scam FROM sums, totals),
prior AS (SELECT ln(count(*) FILTER (status = 'Genuine') / count(*) FILTER (status IN ('Genuine', 'Scam'))) AS prior_genuine, ln(count(*) FILTER (status = 'Scam') / count(*) FILTER (status IN ('Genuine', 'Scam'))) AS prior_scam FROM docs WHERE split = 'train')"""
JUDGED = """judged AS (SELECT l.*, p.status, CASE WHEN prediction = 'Scam' THEN confidence ELSE 100 - confidence END AS score
FROM (SELECT DISTINCT id, row_id, prediction, confidence FROM scan_log) l JOIN processed p USING (row_id) WHERE p.status IN ('Scam', 'Genuine') AND prediction IN ('Scam', 'Genuine'))"""
CONFUSION = f"""{JUDGED}, c AS (SELECT count(*) FILTER (status = 'Scam' AND prediction = 'Scam') AS tp, count(*) FILTER (status = 'Genuine' AND prediction = 'Scam') AS fp,
count(*) FILTER (status = 'Scam' AND prediction = 'Genuine') AS fn, count(*) FILTER (status = 'Genuine' AND prediction = 'Genuine') AS tn FROM judged)"""
REPORT = f"""{CONFUSION}, r AS (SELECT *, tp / (tp + fp) AS pp, tp / (tp + fn) AS pr, 2 * tp / (2 * tp + fp + fn) AS pf, tn / (tn + fn) AS np, tn / (tn + fp) AS nr, 2 * tn / (2 * tn + fp + fn) AS nf, tp + fn AS pn, tn + fp AS nn FROM c),
report AS (SELECT 'Genuine' AS label, np AS precision, nr AS recall, nf AS f1, nn AS support FROM r UNION ALL SELECT 'Scam', pp, pr, pf, pn FROM r
UNION ALL SELECT 'accuracy', (tp + tn) / (pn + nn), (tp + tn) / (pn + nn), (tp + tn) / (pn + nn), pn + nn FROM r
UNION ALL SELECT 'macro avg', (pp + np) / 2, (pr + nr) / 2, (pf + nf) / 2, pn + nn FROM r
UNION ALL SELECT 'weighted avg', (pp * pn + np * nn) / (pn + nn), (pr * pn + nr * nn) / (pn + nn), (pf * pn + nf * nn) / (pn + nn), pn + nn FROM r)"""
STEPS = f"""{JUDGED}, steps AS (SELECT score, count(*) FILTER (status = 'Scam') AS p, count(*) FILTER (status = 'Genuine') AS n FROM judged WHERE score IS NOT NULL GROUP BY score),
run AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM steps UNION ALL SELECT NULL, 0, 0),
turns AS (SELECT *, tp - lag(tp) OVER w AS dt, fp - lag(fp) OVER w AS df, lead(tp) OVER w - tp AS nt, lead(fp) OVER w - fp AS nf FROM run WINDOW w AS (ORDER BY score DESC NULLS FIRST)),
roc AS (SELECT fp / (SELECT sum(n) FROM steps) AS fpr, tp / (SELECT sum(p) FROM steps) AS tpr, score AS threshold FROM turns WHERE dt IS NULL OR nt IS NULL OR dt * nf <> nt * df)"""
CASES = f"cases AS (SELECT *, CASE WHEN {risk('message')} >= 40 THEN 'Scam' ELSE 'Genuine' END AS by_risk, {expected('message')} AS by_words, CASE WHEN contains(lower(message), 'http') OR contains(lower(message), 'www') THEN 'Scam' ELSE 'Genuine' END AS by_links FROM adhoc_cases)"
VOTED = f"""{CASES}, counted AS (SELECT *, CASE WHEN by_risk = 'Scam' THEN 1 ELSE 0 END + CASE WHEN by_words = 'Scam' THEN 1 ELSE 0 END + CASE WHEN by_links = 'Scam' THEN 1 ELSE 0 END AS scam_votes FROM cases),
voted AS (SELECT *, CASE WHEN scam_votes * 2 > 3 THEN 'Scam' ELSE 'Genuine' END AS prediction, greatest(scam_votes, 3 - scam_votes) / 3 * 100 AS confidence FROM counted)"""
ONCE = "once AS (SELECT DISTINCT id, prediction, confidence, scanned_at FROM scan_log)"
RECENT = f"{ONCE}, timed AS (SELECT *, {MICROS} AS \"at\" FROM once), latest AS (SELECT * FROM timed ORDER BY \"at\" DESC, id DESC LIMIT 20), placed AS (SELECT row_number() OVER (ORDER BY \"at\", id) AS place, count(*) OVER () AS c, id, prediction, confidence, \"at\" FROM latest)"


ADMIT = lambda known: f"CASE WHEN msg IS NULL THEN 400 WHEN strlen(msg) > 32768 THEN 413 WHEN length(msg) > 2000 THEN 400 WHEN {strip('msg')} = '' THEN 400 WHEN coalesce(cleaned_msg, '') = '' THEN 400{known} ELSE 200 END"
ADMIT_TEXT = lambda known: f"CASE WHEN msg IS NULL THEN 'message must be text' WHEN strlen(msg) > 32768 THEN 'request too large' WHEN length(msg) > 2000 THEN 'message too long' WHEN {strip('msg')} = '' THEN 'message is blank' WHEN coalesce(cleaned_msg, '') = '' THEN 'no usable text'{known} END"
GRAMS = "list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))"
SCORED = f"""WITH {BAYES}, m0 AS (SELECT track_id AS row_id, sms AS msg, {clean('sms')} AS x FROM tracker), m1 AS (SELECT row_id, msg, array_to_string({stopped(tokens(spelling('x')))}, ' ') AS cleaned_msg FROM m0),
m2 AS (SELECT row_id, list_filter({tokens('cleaned_msg')}, lambda t: length(t) >= 2) AS t FROM m1), m3 AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest({GRAMS}) AS term FROM m2) GROUP BY ALL),
m4 AS (SELECT row_id, (ln(tf) + 1) * idf AS w, theta_genuine, theta_scam FROM m3 JOIN vocab USING (term) JOIN theta USING (term)),
m5 AS (SELECT row_id, count(*) AS k, sum(w * theta_genuine) / sqrt(sum(w * w)) AS g, sum(w * theta_scam) / sqrt(sum(w * w)) AS s FROM m4 GROUP BY row_id),
m6 AS (SELECT row_id, msg, cleaned_msg, coalesce(k, 0) AS k, coalesce(s, 0) + prior_scam - coalesce(g, 0) - prior_genuine AS gap FROM m1 LEFT JOIN m5 USING (row_id), prior),
m7 AS (SELECT row_id, {ADMIT(" WHEN k = 0 THEN 422")} AS status, {ADMIT_TEXT(" WHEN k = 0 THEN 'no known words'")} AS error, gap FROM m6)
SELECT row_id, status, error, CASE WHEN status = 200 THEN CASE WHEN gap > 0 THEN 'Scam' ELSE 'Genuine' END END AS prediction, CASE WHEN status = 200 THEN round_even(100 / (1 + exp(-abs(gap))), 1) END AS confidence FROM m7"""
CROSS = f"""WITH base AS (SELECT row_id, status, cleaned_msg FROM processed WHERE split = 'train' AND cleaned_msg IS NOT NULL AND status IN ('Scam', 'Genuine')),
per AS (SELECT status, count(*) AS n, min(row_id) AS f FROM base GROUP BY status), places AS (SELECT status, n, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM per),
pos AS (SELECT status, unnest(range(s, s + n)) % 5 AS fold FROM places), sz AS (SELECT status, fold, count(*) AS c FROM pos GROUP BY ALL), ends AS (SELECT status, fold, sum(c) OVER (PARTITION BY status ORDER BY fold) AS high, c FROM sz),
r AS (SELECT row_id, status, cleaned_msg, row_number() OVER (PARTITION BY status ORDER BY row_id) - 1 AS k FROM base), rows AS (SELECT row_id, r.status, cleaned_msg, fold FROM r JOIN ends ON r.status = ends.status AND k >= high - c AND k < high),
folds AS (SELECT unnest(range(5)) AS f), d AS (SELECT row_id, status, fold, list_filter({tokens('cleaned_msg')}, lambda t: length(t) >= 2) AS t FROM rows),
tf AS (SELECT row_id, status, fold, term, count(*) AS tf FROM (SELECT row_id, status, fold, unnest({GRAMS}) AS term FROM d) GROUP BY ALL),
size AS (SELECT f, count(*) AS n FROM rows JOIN folds ON fold <> f GROUP BY f), vocab AS (SELECT f, term, ln((max(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf JOIN size ON fold <> f GROUP BY f, term),
w AS (SELECT f, row_id, status, fold, term, (ln(tf) + 1) * idf AS w FROM tf JOIN vocab USING (term)), wn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY f, row_id)) AS weight FROM w),
sums AS (SELECT f, term, sum(CASE WHEN status = 'Genuine' THEN weight ELSE 0 END) AS g, sum(CASE WHEN status = 'Scam' THEN weight ELSE 0 END) AS s FROM wn WHERE fold <> f GROUP BY f, term),
totals AS (SELECT f, count(*) AS v, sum(g) AS tg, sum(s) AS ts FROM sums GROUP BY f), theta AS (SELECT f, term, ln((g + 1) / (tg + v)) AS theta_genuine, ln((s + 1) / (ts + v)) AS theta_scam FROM sums JOIN totals USING (f)),
prior AS (SELECT f, ln(count(*) FILTER (status = 'Genuine') / count(*)) AS pg, ln(count(*) FILTER (status = 'Scam') / count(*)) AS ps FROM rows JOIN folds ON fold <> f GROUP BY f),
sc AS (SELECT f, row_id, sum(weight * theta_genuine) AS g, sum(weight * theta_scam) AS s FROM wn JOIN theta USING (f, term) WHERE fold = f GROUP BY f, row_id),
judged AS (SELECT rows.fold, status, CASE WHEN coalesce(s, 0) + ps - coalesce(g, 0) - pg > 0 THEN 'Scam' ELSE 'Genuine' END AS prediction FROM rows JOIN prior ON prior.f = fold LEFT JOIN sc ON sc.row_id = rows.row_id AND sc.f = fold),
c AS (SELECT fold, count(*) FILTER (status = 'Scam' AND prediction = 'Scam') AS tp, count(*) FILTER (status = 'Genuine' AND prediction = 'Scam') AS fp, count(*) FILTER (status = 'Scam' AND prediction = 'Genuine') AS fn, count(*) FILTER (status = 'Genuine' AND prediction = 'Genuine') AS tn FROM judged GROUP BY fold),
f1 AS (SELECT (2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / (tp + fp + fn + tn) AS f1 FROM c)
SELECT min(f1) AS low, max(f1) AS high, avg(f1) AS mean, stddev_pop(f1) AS spread FROM f1"""


TEXT_OR_NAN = strip("coalesce(msg, 'nan')")


def _quality(policy: str) -> str:
    minus = " - count(*) FILTER (clash)" if policy == "drop" else ""
    return f"""WITH {RAW}, keyed AS (SELECT {key('msg')} AS k, msg IS NULL AS m, msg IS NOT NULL AND {strip('msg')} = '' AS e, {missing_label('status')} AS ml,
NOT {missing_label('status')} AND {label('status')} IS NULL AS il, CASE WHEN msg IS NOT NULL AND {strip('msg')} <> '' THEN {label('status')} END AS label FROM raw),
per AS (SELECT k, count(*) AS n, count(*) FILTER (m) AS m, count(*) FILTER (e) AS e, count(*) FILTER (ml) AS ml, count(*) FILTER (il) AS il, count(label) AS valid, coalesce(min(label) <> max(label), false) AS clash FROM keyed GROUP BY k)
SELECT sum(n)::BIGINT AS total_rows, sum(m)::BIGINT AS missing_messages, sum(e)::BIGINT AS empty_messages, sum(ml)::BIGINT AS missing_labels, sum(il)::BIGINT AS invalid_labels,
(sum(n) - count(*))::BIGINT AS duplicate_rows, count(*) FILTER (clash) AS conflicting_keys, count(*) FILTER (valid > 0){minus} AS surviving_rows FROM per"""


def _nested(inner: str, outer: str) -> str:
    """Long expressions in steps, so that none is repeated in the statement."""
    return f"WITH a AS (SELECT row_id, {inner} AS x FROM processed) SELECT row_id, {outer} AS cleaned FROM a"


def _pipeline(quota: str) -> str:
    """The pipeline's counters, stage by stage, each from the rows of the stage before."""
    stage = lambda name, columns: ", ".join(f"{name}.{c} AS {name}_{c}" for c in columns.split())
    return f"""WITH {GROUPS}, validation AS (SELECT * FROM ({_quality('drop')})),
invalid AS (SELECT count(*) FILTER (msg IS NULL) AS missing, count(*) FILTER (msg IS NOT NULL AND {strip('msg')} = '') AS empty, count(*) FILTER (status IS NULL) AS bad_label, count(*) FILTER (msg IS NOT NULL AND {strip('msg')} <> '' AND status IS NOT NULL) AS kept FROM labelled),
duplicates AS (SELECT coalesce(sum(CASE WHEN clash THEN 0 ELSE n - 1 END), 0)::BIGINT AS duplicates_removed, count(*) FILTER (clash) AS conflicting_keys, coalesce(sum(CASE WHEN clash THEN n ELSE 0 END), 0)::BIGINT AS conflicting_rows_removed, count(*) FILTER (NOT clash) AS rows_left FROM groups),
c0 AS (SELECT row_id, status, source, {clean('msg')} AS x FROM valid JOIN groups ON row_id = f WHERE NOT clash),
cleaned AS (SELECT * FROM (SELECT row_id, status, source, array_to_string({stopped(tokens(spelling('x')))}, ' ') AS cleaned_msg FROM c0) WHERE cleaned_msg <> ''),
tg AS (SELECT cleaned_msg, count(*) AS n FROM cleaned GROUP BY 1), templates AS (SELECT count(*) AS unique_texts, sum(n - 1)::BIGINT AS duplicate_rows, count(*) FILTER (n > 1) AS groups, coalesce(max(n) FILTER (n > 1), 0) AS largest FROM tg),
statistics AS (SELECT count(*) AS total, count(*) FILTER (status = 'Scam') AS scam, count(*) FILTER (status = 'Genuine') AS genuine, count(*) FILTER (source = 'Authentic') AS authentic, count(*) FILTER (source = 'Synthetic') AS synthetic FROM cleaned),
{quota.replace('FROM processed', 'FROM cleaned')}, pr AS (SELECT row_id, status, row_number() OVER (PARTITION BY status ORDER BY md5('42-' || row_id), row_id) AS rank FROM cleaned),
parts AS (SELECT cleaned.*, CASE WHEN rank <= n_train THEN 'train' ELSE 'test' END AS split FROM cleaned JOIN pr USING (row_id) JOIN quota ON quota.status = cleaned.status),
tk AS (SELECT DISTINCT cleaned_msg AS k FROM parts WHERE split = 'train'), ov AS (SELECT count(*) AS n_test, count(k) AS n_overlap FROM parts LEFT JOIN tk ON cleaned_msg = k WHERE split = 'test'),
overlap AS (SELECT n_test, n_overlap, CASE WHEN n_test > 0 THEN round_even(n_overlap / n_test * 100, 2) ELSE 0.0 END AS percent FROM ov),
ft AS (SELECT list_filter({tokens('cleaned_msg')}, lambda t: length(t) >= 2) AS t FROM parts WHERE split = 'train'), features AS (SELECT count(DISTINCT term) AS n_features FROM (SELECT unnest({GRAMS}) AS term FROM ft))
SELECT {stage('validation', 'total_rows missing_messages empty_messages missing_labels invalid_labels duplicate_rows conflicting_keys surviving_rows')}, {stage('invalid', 'missing empty bad_label kept')}, {stage('duplicates', 'duplicates_removed conflicting_keys conflicting_rows_removed rows_left')},
{stage('templates', 'unique_texts duplicate_rows groups largest')}, {stage('statistics', 'total scam genuine authentic synthetic')}, {stage('overlap', 'n_test n_overlap percent')}, {stage('features', 'n_features')}
FROM validation, invalid, duplicates, templates, statistics, overlap, features"""


def sql() -> dict[str, str]:
    histogram = f"""WITH sized AS (SELECT 'raw' AS text, len({tokens('msg')}) AS x FROM processed WHERE msg IS NOT NULL UNION ALL SELECT 'cleaned', len({tokens('cleaned_msg')}) FROM processed WHERE cleaned_msg IS NOT NULL),
ends AS (SELECT text, min(x) AS low, max(x) AS high FROM sized GROUP BY text)
SELECT text, CAST(CASE WHEN high > low THEN least(floor((x - low) * 30 / (high - low)), 29) ELSE 0 END AS INT) AS bin, count(*) AS n FROM sized JOIN ends USING (text) GROUP BY ALL"""
    quota = """q AS (SELECT status, n, n * train // total AS base, n * train % total AS rest, train FROM (
SELECT status, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total, (sum(count(*)) OVER () - ceil(sum(count(*)) OVER () * 0.2))::BIGINT AS train FROM processed WHERE status IS NOT NULL GROUP BY status)),
quota AS (SELECT status, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, status) <= train - sum(base) OVER () THEN 1 ELSE 0 END AS n_train FROM q)"""
    return {
        "label_normalize": f"SELECT raw_id AS row_id, {label('status')} AS status FROM raw_messages",
        "source_normalize": f"SELECT raw_id AS row_id, {source('source')} AS source FROM raw_messages",
        "missing_and_invalid_flags": f"SELECT raw_id AS row_id, msg IS NULL AS missing_msg, msg IS NOT NULL AND {strip('msg')} = '' AS empty_msg, {missing_label('status')} AS missing_label, NOT {missing_label('status')} AND {label('status')} IS NULL AS invalid_label FROM raw_messages",
        "quality_report": _quality("drop"),
        "quality_report_first": _quality("first"),
        "remove_invalid": f"WITH {VALID} SELECT row_id, status, source FROM valid",
        "removal_counts": f"WITH {LABELLED}, f AS (SELECT msg IS NULL AS m, msg IS NOT NULL AND {strip('msg')} = '' AS e, status IS NULL AS b FROM labelled) SELECT count(*) FILTER (m) AS missing, count(*) FILTER (e) AS empty, count(*) FILTER (b) AS bad_label, count(*) FILTER (NOT (m OR e OR b)) AS kept FROM f",
        "respelled_labels": f"SELECT status AS spelling, {label('status')} AS meaning, count(*) AS n FROM raw_messages WHERE {label('status')} <> status GROUP BY ALL",
        "respelled_sources": f"SELECT source AS spelling, {source('source')} AS meaning, count(*) AS n FROM raw_messages WHERE {source('source')} <> source GROUP BY ALL",
        "unknown_labels": f"SELECT status AS spelling, count(*) AS n FROM raw_messages WHERE NOT {missing_label('status')} AND {label('status')} IS NULL GROUP BY ALL",
        "describe": f"SELECT field, value, count(*) AS n FROM (SELECT 'status' AS field, coalesce({strip('status')}, 'nan') AS value FROM raw_messages UNION ALL SELECT 'source', coalesce({strip('source')}, 'nan') FROM raw_messages) GROUP BY ALL",
        "duplicate_key": f"SELECT raw_id AS row_id, {key('msg')} AS key FROM raw_messages",
        "flag_duplicates": f"SELECT raw_id AS row_id, row_number() OVER (PARTITION BY {key('msg')} ORDER BY raw_id) > 1 AS is_duplicate FROM raw_messages",
        "dedup_keep_first": f"WITH {GROUPS} SELECT row_id, status FROM valid JOIN groups ON row_id = f",
        "dedup_conflict_drop": f"WITH {GROUPS} SELECT row_id, status FROM valid JOIN groups ON row_id = f WHERE NOT clash",
        "dedup_conflict_first": f"WITH {GROUPS} SELECT row_id, status FROM valid JOIN groups ON row_id = f",
        "duplicate_report_drop": f"WITH {GROUPS} SELECT sum(CASE WHEN clash THEN 0 ELSE n - 1 END)::BIGINT AS duplicates_removed, count(*) FILTER (clash) AS conflicting_keys, sum(CASE WHEN clash THEN n ELSE 0 END)::BIGINT AS conflicting_rows_removed, count(*) FILTER (NOT clash) AS rows_left FROM groups",
        "duplicate_report_first": f"WITH {GROUPS} SELECT sum(n - 1)::BIGINT AS duplicates_removed, count(*) FILTER (clash) AS conflicting_keys, 0::BIGINT AS conflicting_rows_removed, count(*) AS rows_left FROM groups",
        "conflict_examples": f"WITH {GROUPS} SELECT min(row_id) AS first_row_id, arg_min(left(msg, 160), row_id) AS text, string_agg(DISTINCT status, ',' ORDER BY status) AS labels, count(*) AS copies FROM valid JOIN groups USING (k) WHERE clash GROUP BY k ORDER BY 1 LIMIT 10",
        "conflicting_rows": f"WITH {GROUPS} SELECT row_id, status FROM valid JOIN groups USING (k) WHERE clash",
        "raw_conflicts": f"WITH k AS (SELECT raw_id AS row_id, status, lower({TEXT_OR_NAN}) AS k FROM raw_messages), c AS (SELECT k FROM k GROUP BY k HAVING min(status) <> max(status)) SELECT row_id, status FROM k WHERE k IN (FROM c)",
        "blank_rows": f"SELECT raw_id AS row_id FROM raw_messages WHERE msg IS NULL OR {strip('msg')} = ''",
        "template_groups": "WITH g AS (SELECT cleaned_msg, count(*) AS n FROM processed GROUP BY 1) SELECT count(*) AS unique_texts, sum(n - 1)::BIGINT AS duplicate_rows, count(*) FILTER (n > 1) AS groups, coalesce(max(n) FILTER (n > 1), 0) AS largest FROM g",
        "largest_template": "WITH g AS (SELECT cleaned_msg, count(*) AS copies FROM processed WHERE cleaned_msg IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, min(row_id) LIMIT 1) SELECT row_id, cleaned_msg, copies FROM processed JOIN g USING (cleaned_msg) ORDER BY row_id LIMIT 5",
        "clean_url": f"SELECT row_id, {urls('lower(msg)')} AS cleaned FROM processed",
        "clean_numbers": f"SELECT row_id, {numbers('lower(msg)')} AS cleaned FROM processed",
        "clean_numbers_removed": f"SELECT row_id, {numbers('lower(msg)', ' ', False)} AS cleaned FROM processed",
        "clean_text": f"SELECT row_id, {clean('msg')} AS cleaned FROM processed",
        "spelling_normalize": f"SELECT row_id, {spelling('cleaned_msg')} AS cleaned FROM processed",
        "stopword_filter": _nested(clean("msg"), f"array_to_string({stopped(tokens('x'))}, ' ')"),
        "preprocess_text": _nested(clean("msg"), f"array_to_string({stopped(tokens(spelling('x')))}, ' ')"),
        "empty_after_clean": "SELECT row_id FROM (" + _nested(clean("msg"), f"array_to_string({stopped(tokens(spelling('x')))}, ' ')") + ") WHERE cleaned = ''",
        "shorten_text": "SELECT row_id, CASE WHEN length(msg) > 90 THEN left(msg, 90) || '...' ELSE msg END AS short FROM processed",
        "ngrams": f"WITH {TERMS} SELECT row_id, array_to_string(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])), '|') AS terms FROM docs",
        "label_stats": "SELECT count(*) AS total, count(*) FILTER (status = 'Scam') AS scam, count(*) FILTER (status = 'Genuine') AS genuine, count(*) FILTER (source = 'Authentic') AS authentic, count(*) FILTER (source = 'Synthetic') AS synthetic FROM processed",
        "label_shares": "SELECT status AS value, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM processed WHERE status IS NOT NULL GROUP BY 1",
        "source_stats": "SELECT source AS value, count(*) AS n, min(row_id) AS first_row_id FROM processed GROUP BY 1",
        "label_source_sets": "SELECT status, source, CAST(grouping(status, source) AS INT) AS level, count(*) AS n FROM processed GROUP BY GROUPING SETS ((status), (source), ())",
        "words_by_label": f"WITH {WORDS} SELECT * FROM words",
        "top_words_by_class": f"WITH {TOP} SELECT * FROM ranked WHERE rank <= 15",
        "top_words_zip": f"WITH {TOP}, s AS (SELECT rank, word AS scam_word, n AS scam_n FROM ranked WHERE status = 'Scam' AND rank <= 15), g AS (SELECT rank, word AS genuine_word, n AS genuine_n FROM ranked WHERE status = 'Genuine' AND rank <= 15) SELECT * FROM s FULL JOIN g USING (rank)",
        "distinctive_words": f"WITH {TOP}, both_n AS (SELECT word, coalesce(sum(n) FILTER (status = 'Scam'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (status = 'Genuine'), 0)::BIGINT AS g FROM words GROUP BY word) SELECT status, word, n, CASE WHEN status = 'Scam' THEN g ELSE s END AS n_other, rank FROM ranked JOIN both_n USING (word) WHERE rank <= 200 AND status IN ('Scam', 'Genuine') AND (CASE WHEN status = 'Scam' THEN g ELSE s END) * 4 < n",
        "word_count_histogram": histogram,
        "word_count_quartiles": f"WITH x AS (SELECT status, len({tokens('cleaned_msg')}) AS x FROM processed WHERE status IS NOT NULL AND cleaned_msg IS NOT NULL) SELECT status, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, CAST(min(x) AS INT) AS low, CAST(max(x) AS INT) AS high, avg(x) AS mean, stddev_pop(x) AS spread FROM x GROUP BY status",
        "summary_unpivot": "WITH s AS (SELECT count(*) AS total, count(*) FILTER (status = 'Scam') AS scam, count(*) FILTER (status = 'Genuine') AS genuine, count(*) FILTER (source = 'Authentic') AS authentic, count(*) FILTER (source = 'Synthetic') AS synthetic FROM processed) SELECT metric, value::VARCHAR AS value FROM (UNPIVOT s ON total, scam, genuine, authentic, synthetic INTO NAME metric VALUE value)",
        "seeded_sample": "SELECT row_id FROM processed ORDER BY md5('42-' || row_id), row_id LIMIT 25",
        "split_quota": f"WITH {quota} SELECT status, n, n_train::BIGINT AS n_train, (n - n_train)::BIGINT AS n_test FROM quota",
        "stratified_split": f"WITH {quota}, r AS (SELECT row_id, status, row_number() OVER (PARTITION BY status ORDER BY md5('42-' || row_id), row_id) AS rank FROM processed WHERE status IS NOT NULL) SELECT row_id, status, CASE WHEN rank <= n_train THEN 'train' ELSE 'test' END AS split FROM r JOIN quota USING (status)",
        "train_test_split": f"WITH {quota}, r AS (SELECT row_id, status, row_number() OVER (PARTITION BY status ORDER BY md5('42-' || row_id), row_id) AS rank FROM processed WHERE status IS NOT NULL) SELECT row_id, status, CASE WHEN rank <= n_train THEN 'train' ELSE 'test' END AS split FROM r JOIN quota USING (status)",
        "golden_differences": "WITH p AS (" + _nested(clean("msg"), f"array_to_string({stopped(tokens(spelling('x')))}, ' ')") + ") SELECT row_id, cleaned AS found, cleaned_msg AS wanted FROM p JOIN processed USING (row_id) WHERE cleaned IS DISTINCT FROM cleaned_msg",
        "scan_append": "SELECT row_number() OVER (ORDER BY track_id) + (SELECT coalesce(max(id), 0) FROM scan_log) AS id, prediction, confidence::DOUBLE AS confidence, '2024-03-01T00:00:00.000000+00:00' AS scanned_at FROM tracker",
        "cv_folds": """WITH per AS (SELECT status, count(*) AS n, min(row_id) AS f FROM processed WHERE status IS NOT NULL GROUP BY status), places AS (SELECT status, n, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM per),
pos AS (SELECT status, unnest(range(s, s + n)) % 5 AS fold FROM places), size AS (SELECT status, fold, count(*) AS c FROM pos GROUP BY ALL), ends AS (SELECT status, fold, sum(c) OVER (PARTITION BY status ORDER BY fold) AS high, c FROM size),
r AS (SELECT row_id, status, row_number() OVER (PARTITION BY status ORDER BY row_id) - 1 AS k FROM processed WHERE status IS NOT NULL) SELECT row_id, r.status, CAST(fold AS INT) AS fold FROM r JOIN ends ON r.status = ends.status AND k >= high - c AND k < high""",
        "train_test_overlap": "WITH t AS (SELECT DISTINCT cleaned_msg AS k FROM processed WHERE split = 'train' AND cleaned_msg IS NOT NULL), x AS (SELECT count(*) AS n_test, count(k) AS n_overlap FROM processed LEFT JOIN t ON cleaned_msg = k WHERE split = 'test') SELECT n_test, n_overlap, CASE WHEN n_test > 0 THEN round_even(n_overlap / n_test * 100, 2) ELSE 0.0 END AS percent FROM x",
        "term_frequency": f"WITH {TERMS} SELECT row_id, term, tf FROM tf WHERE split = 'train'",
        "document_frequency": f"WITH {TERMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf WHERE split = 'train' GROUP BY term",
        "idf": f"WITH {FITTED} SELECT term, df, round(idf, 6) AS idf FROM vocab",
        "vocab_pruned": f"WITH {FITTED}, kept AS (SELECT term, df FROM vocab, size WHERE df >= 2 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT 1500) SELECT term, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS idx FROM kept",
        "tfidf_train": f"WITH {FITTED} SELECT row_id, term, round(weight, 6) AS weight FROM weights WHERE split = 'train'",
        "tfidf_test": f"WITH {FITTED} SELECT row_id, term, round(weight, 6) AS weight FROM weights WHERE split = 'test'",
        "sparsity": f"WITH {FITTED}, c AS (SELECT (SELECT count(*) FROM docs WHERE split = 'test') AS n_rows, (SELECT count(*) FROM vocab) AS n_features, (SELECT count(*) FROM weights WHERE split = 'test') AS n_entries) SELECT *, 1 - n_entries / (n_rows * n_features) AS sparsity FROM c",
        "nb_prior": f"WITH {BAYES} SELECT * FROM prior",
        "nb_theta": f"WITH {BAYES} SELECT term, round(theta_genuine, 6) AS theta_genuine, round(theta_scam, 6) AS theta_scam FROM theta",
        "nb_predict": f"WITH {BAYES}, s AS (SELECT row_id, count(*) AS k, sum(weight * theta_genuine) AS g, sum(weight * theta_scam) AS s FROM weights JOIN theta USING (term) WHERE split = 'test' GROUP BY row_id), j AS (SELECT row_id, coalesce(k, 0) AS known_terms, coalesce(s, 0) + prior_scam - coalesce(g, 0) - prior_genuine AS gap FROM docs LEFT JOIN s USING (row_id), prior WHERE split = 'test') SELECT row_id, CASE WHEN gap > 0 THEN 'Scam' ELSE 'Genuine' END AS prediction, round_even(100 / (1 + exp(-abs(gap))), 1) AS confidence, known_terms FROM j",
        "score_admission": f"SELECT row_id, CASE WHEN msg IS NULL THEN 400 WHEN strlen(msg) > 32768 THEN 413 WHEN length(msg) > 2000 THEN 400 WHEN {strip('msg')} = '' THEN 400 WHEN coalesce(cleaned_msg, '') = '' THEN 400 ELSE 200 END AS code, CASE WHEN msg IS NULL THEN 'message must be text' WHEN strlen(msg) > 32768 THEN 'request too large' WHEN length(msg) > 2000 THEN 'message too long' WHEN {strip('msg')} = '' THEN 'message is blank' WHEN coalesce(cleaned_msg, '') = '' THEN 'no usable text' END AS error FROM processed",
        "score_messages": SCORED,
        "nb_cv": CROSS,
        "pipeline_report": _pipeline(quota),
        "batch_totals": f"WITH {VOTED} SELECT count(*) AS total, count(*) FILTER (prediction = 'Scam') AS scam, count(*) FILTER (prediction <> 'Scam') AS genuine FROM voted",
        "console_safe": "SELECT row_id, CASE WHEN length(msg) > 60 THEN left(regexp_replace(msg, '[^\\x00-\\x7F]', '?', 'g'), 60) || '...' ELSE regexp_replace(msg, '[^\\x00-\\x7F]', '?', 'g') END AS shown FROM processed",
        "scan_local_time": f"WITH t AS (SELECT id, {MICROS} AS us FROM scan_log) SELECT id, strftime(make_timestamp(us) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS shown FROM t",
        "stream_scan_totals": "SELECT count(*) AS total, count(*) FILTER (prediction = 'Scam') AS scam FROM scan_log",
        "keyword_risk": f"WITH s AS (SELECT row_id, {risk('msg')} AS s FROM processed) SELECT row_id, least(s, 100) AS risk_score, {level('s')} AS risk_level FROM s",
        "keyword_hits": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT row_id, '{c}' AS category, array_to_string(list_filter({list(w)!r}, lambda w: contains(lower(msg), w)), ',') AS words FROM processed WHERE msg IS NOT NULL" for c, w in lexicon.RISK_KEYWORDS.items()) + ") WHERE words <> ''",
        "expected_label": f"SELECT row_id, {expected('msg')} AS label FROM processed",
        "ensemble_vote": f"WITH {VOTED} SELECT case_id, scam_votes, prediction, confidence FROM voted",
        "vote_map": f"WITH {CASES} SELECT case_id, 'NB' AS model, by_risk AS prediction FROM cases UNION ALL SELECT case_id, 'LR', by_words FROM cases UNION ALL SELECT case_id, 'SVM', by_links FROM cases",
        "display_formats": "SELECT track_id, upper(left(risk_level, 1)) || lower(substr(risk_level, 2)) AS level, format('{:,}', row_id) AS number, upper(prediction) AS label FROM tracker",
        "final_verdict": f"WITH {VOTED} SELECT case_id, CASE WHEN prediction = 'Scam' AND {risk('message')} > 50 THEN 'confirmed scam' WHEN prediction = 'Scam' THEN 'likely scam' WHEN {risk('message')} > 50 THEN 'suspicious' ELSE 'genuine' END AS verdict FROM voted",
        "batch_detect": f"WITH {VOTED}, s AS (SELECT *, {risk('message')} AS s FROM voted) SELECT case_id, left(message, 50) AS sms, prediction, printf('%.0f%%', confidence) AS confidence, scam_votes, {level('s')} AS risk_level, least(s, 100) AS risk_score FROM s",
        "confusion": f"WITH {CONFUSION} SELECT * FROM c",
        "prf": f"WITH {CONFUSION} SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c",
        "classification_report": f"WITH {REPORT} SELECT * FROM report",
        "weighted_f1": f"WITH {REPORT} SELECT f1 FROM report WHERE label = 'weighted avg'",
        "roc_points": f"WITH {STEPS} SELECT * FROM roc",
        "auc_rank": f"WITH {STEPS}, b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM steps) SELECT (sum(p * (below + n / 2)) / (sum(p) * sum(n)))::DOUBLE AS auc FROM b",
        "auc_trapezoid": f"WITH {STEPS}, l AS (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr, tpr) AS x, lag(tpr) OVER (ORDER BY fpr, tpr) AS y FROM roc) SELECT sum((fpr - x) * (tpr + y) / 2) AS auc FROM l",
        "accuracy_by_scenario": f"WITH {VOTED} SELECT scenario, count(*) AS n, count(*) FILTER (prediction = expected) AS correct, avg(CASE WHEN prediction = expected THEN 1 ELSE 0 END) AS accuracy FROM voted WHERE expected IN ('Scam', 'Genuine') GROUP BY scenario",
        "model_comparison": f"""WITH {CASES}, long AS (SELECT 'by_risk' AS model, 0 AS place, expected AS s, by_risk AS p FROM cases UNION ALL SELECT 'by_words', 1, expected, by_words FROM cases UNION ALL SELECT 'by_links', 2, expected, by_links FROM cases),
c AS (SELECT model, place, count(*) FILTER (s = 'Scam' AND p = 'Scam') AS tp, count(*) FILTER (s = 'Genuine' AND p = 'Scam') AS fp, count(*) FILTER (s = 'Scam' AND p = 'Genuine') AS fn, count(*) FILTER (s = 'Genuine' AND p = 'Genuine') AS tn FROM long GROUP BY ALL),
m AS (SELECT model, place, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
SELECT model, accuracy, precision, recall, f1, CAST(row_number() OVER (ORDER BY f1 DESC, place) AS INT) AS rank FROM m""",
        "mean_over_models": f"""WITH {CASES}, long AS (SELECT 'by_risk' AS model, 0 AS place, expected AS s, by_risk AS p FROM cases UNION ALL SELECT 'by_words', 1, expected, by_words FROM cases UNION ALL SELECT 'by_links', 2, expected, by_links FROM cases),
c AS (SELECT model, place, count(*) FILTER (s = 'Scam' AND p = 'Scam') AS tp, count(*) FILTER (s = 'Genuine' AND p = 'Scam') AS fp, count(*) FILTER (s = 'Scam' AND p = 'Genuine') AS fn, count(*) FILTER (s = 'Genuine' AND p = 'Genuine') AS tn FROM long GROUP BY ALL),
m AS (SELECT model, place, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
SELECT avg(f1) AS mean_f1, count(f1) AS n_models FROM m""",
        "scan_validate": f"SELECT count(*) AS n, count(*) FILTER (id IS NULL OR id < 1) AS bad_id, count(id) - count(DISTINCT id) AS repeated_id, count(*) FILTER (NOT coalesce(prediction IN ('Scam', 'Genuine'), false)) AS bad_prediction, count(*) FILTER (confidence IS NOT NULL AND NOT (confidence BETWEEN 0 AND 100)) AS bad_confidence, count(*) FILTER (({MICROS}) IS NULL) AS bad_time FROM scan_log",
        "scan_summary": f"WITH {ONCE}, c AS (SELECT count(*) AS total, count(*) FILTER (prediction = 'Scam') AS scam FROM once) SELECT total, scam, total - scam AS authentic, CASE WHEN total > 0 THEN round_even(scam / total * 100, 1) ELSE 0 END AS scam_percent, CASE WHEN total > 0 THEN round_even((total - scam) / total * 100, 1) ELSE 0 END AS authentic_percent FROM c",
        "scan_recent20": f"WITH {RECENT} SELECT CAST(place AS INT) AS place, id, prediction, confidence, \"at\" FROM placed",
        "scan_display": f"WITH {RECENT} SELECT id, CASE WHEN prediction = 'Genuine' THEN 'Authentic' ELSE prediction END AS label, CASE WHEN confidence IS NULL THEN 'Unavailable' ELSE printf('%.1f%%', confidence) END AS shown, CASE WHEN c = 1 THEN 310.0 ELSE 55 + (place - 1) * 505.0 / (c - 1) END::DOUBLE AS x, (195 - confidence * 1.65)::DOUBLE AS y, c - place + 1 AS row FROM placed",
        "donut_arcs": f"WITH {ONCE}, p AS (SELECT CASE WHEN prediction = 'Scam' THEN 'Scam' ELSE 'Authentic' END AS label, count(*) AS n FROM once GROUP BY 1), s AS (SELECT label, n, (n * 100.0 / sum(n) OVER ())::DOUBLE AS length FROM p) SELECT *, coalesce(sum(length) OVER (ORDER BY label DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM s",
        "scan_ids": "SELECT track_id, prediction, row_number() OVER (ORDER BY track_id) + (SELECT coalesce(max(id), 0) FROM scan_log) AS id FROM tracker",
        "export_parts": f"WITH {ONCE}, t AS (SELECT *, make_timestamp({MICROS}) AS ts FROM once) SELECT id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S.%f') AS time, strftime(ts, '%H:%M') AS short_time, prediction, confidence FROM t",
        "tracker_summary": "WITH c AS (SELECT count(*) AS total_checked, count(*) FILTER (prediction = 'Scam') AS scam_count FROM tracker) SELECT total_checked, scam_count, total_checked - scam_count AS genuine_count, scam_count / total_checked * 100 AS scam_percent, (total_checked - scam_count) / total_checked * 100 AS genuine_percent FROM c",
        "tracker_tail": "SELECT track_id, left(sms, 40) AS sms, prediction, confidence, risk_level FROM tracker ORDER BY track_id DESC LIMIT 10",
    }
