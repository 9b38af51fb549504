"""Independent SQL (DuckDB dialect) for every deterministic query.

Written from the specification of each query, not from the Spark plans: plain
windows instead of bucketed ranks, cross products over the small candidate
list, list functions instead of generators. Views ``documents labels
conversations events`` are registered by the caller.
"""

from __future__ import annotations

from moodline.operators.scorer import ADVICE

# The regex classes in RE2 syntax (RE2's \s lacks \x0B).
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]
ALPHAS = [0.1, 0.5, 1.0, 2.0]


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+\\z', '', 'g')"


def remove_mentions(x: str) -> str:
    return strip(f"regexp_replace({x}, '@{WORD}+{SPACE}*', '', 'g')")


def capitalize(x: str) -> str:
    return f"(upper(left({x}, 1)) || lower(substr({x}, 2)))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}+')"


def pct(x: str) -> str:
    return f"format('{{:.1f}}%', ({x}) * 100)"


NAME = "CASE {c} WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END"


def raw_label(code: str, key: str) -> str:
    nm = NAME.format(c=code)
    d = f"substr(md5(CAST({key} AS VARCHAR)), 1, 1)"
    return f"""CASE WHEN {code} IS NULL THEN NULL
      WHEN {d} IN ('0','1','2','3') THEN {nm}
      WHEN {d} IN ('4','5','6') THEN ' ' || {nm} || '  '
      WHEN {d} IN ('7','8','9') THEN upper({nm})
      WHEN {d} IN ('a','b','c') THEN lower({nm})
      WHEN {d} = 'd' THEN '  ' || upper({nm}) || ' '
      WHEN {d} = 'e' THEN 'very ' || lower({nm})
      ELSE 'unsure' END"""


POSTS = f"""posts AS (
  SELECT d.doc_id, d.text AS original_text,
         nullif({remove_mentions('d.text')}, '') AS text,
         d.source AS platform,
         {raw_label('l.code', 'd.doc_id')} AS raw_label
  FROM documents d LEFT JOIN (
    SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1
                        WHEN quality IS NOT NULL THEN 2 END AS code
    FROM labels) l ON d.doc_id = l.doc_id)"""

LABELLED = f"""lp AS (
  SELECT doc_id, text, platform, label FROM (
    SELECT doc_id, text, platform,
           CASE lower({strip('raw_label')}) WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1
                WHEN 'positive' THEN 2 END AS label
    FROM posts WHERE text IS NOT NULL AND raw_label IS NOT NULL) WHERE label IS NOT NULL)"""

QUOTAS = """cc AS (SELECT label, count(*) AS n_class FROM lp GROUP BY label),
tt AS (SELECT sum(n_class) AS n_all, (sum(n_class) * 200000 + 999999) // 1000000 AS t_all FROM cc),
qf AS (SELECT label, n_class, n_all, t_all, (n_class * t_all) // n_all AS q_floor,
              (n_class * t_all) % n_all AS rem FROM cc, tt),
quotas AS (
  SELECT label, n_class,
         q_floor + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                             <= t_all - sum(q_floor) OVER () THEN 1 ELSE 0 END AS quota
  FROM qf)"""

SPLIT = """ranked AS (
  SELECT doc_id, label, row_number() OVER (
           PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
  FROM lp),
split AS (
  SELECT r.doc_id, r.label, CASE WHEN r.rn <= q.quota THEN 'test' ELSE 'train' END AS split
  FROM ranked r JOIN quotas q ON r.label = q.label)"""


def model_ctes(alpha: float = 1.0) -> str:
    a = f"{alpha!r}::DOUBLE"
    return f"""train AS (
  SELECT p.doc_id, p.text, s.label FROM posts p JOIN split s ON p.doc_id = s.doc_id
  WHERE s.split = 'train'),
counts AS (
  SELECT token, count_if(label = 0) AS n0, count_if(label = 1) AS n1, count_if(label = 2) AS n2,
         count(*) AS n_occ
  FROM (SELECT label, unnest({tokens('text')}) AS token FROM train) GROUP BY token),
totals AS (SELECT count(*) AS v, sum(n0) AS t0, sum(n1) AS t1, sum(n2) AS t2 FROM counts),
weights AS (
  SELECT c.token, c.n0, c.n1, c.n2, c.n_occ,
         CAST(round(ln((c.n0 + {a}) / (t.t0 + {a} * t.v)) * 1000000.0::DOUBLE) AS BIGINT) AS wq0,
         CAST(round(ln((c.n1 + {a}) / (t.t1 + {a} * t.v)) * 1000000.0::DOUBLE) AS BIGINT) AS wq1,
         CAST(round(ln((c.n2 + {a}) / (t.t2 + {a} * t.v)) * 1000000.0::DOUBLE) AS BIGINT) AS wq2
  FROM counts c, totals t),
priors AS (
  SELECT ln((count_if(label = 0) + {a}) / (count(*) + 3 * {a})) AS pr0,
         ln((count_if(label = 1) + {a}) / (count(*) + 3 * {a})) AS pr1,
         ln((count_if(label = 2) + {a}) / (count(*) + 3 * {a})) AS pr2
  FROM train)"""


def score_ctes(source: str, keys: list[str], text: str = "text", name: str = "pr") -> str:
    """Scores of the rows of ``source`` with at least one known token."""
    k = ", ".join(keys)
    return f"""{name}_occ AS (
  SELECT {k}, unnest({tokens(text)}) AS token FROM {source}
  WHERE {text} IS NOT NULL AND length({text}) > 0),
{name}_sums AS (
  SELECT {k}, sum(w.wq0) AS s0, sum(w.wq1) AS s1, sum(w.wq2) AS s2, count(*) AS n_known
  FROM {name}_occ o JOIN weights w ON o.token = w.token GROUP BY {k}),
{name}_lg AS (
  SELECT {k}, n_known,
         pr0 + CAST(s0 AS DOUBLE) / 1000000.0::DOUBLE / sqrt(CAST(n_known AS DOUBLE)) AS l0,
         pr1 + CAST(s1 AS DOUBLE) / 1000000.0::DOUBLE / sqrt(CAST(n_known AS DOUBLE)) AS l1,
         pr2 + CAST(s2 AS DOUBLE) / 1000000.0::DOUBLE / sqrt(CAST(n_known AS DOUBLE)) AS l2
  FROM {name}_sums, priors),
{name}_e AS (
  SELECT {k}, n_known, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1,
         exp(l2 - greatest(l0, l1, l2)) AS e2 FROM {name}_lg),
{name} AS (
  SELECT {k}, n_known, round(e0 / (e0 + e1 + e2), 9) AS p_negative,
         round(e1 / (e0 + e1 + e2), 9) AS p_neutral, round(e2 / (e0 + e1 + e2), 9) AS p_positive
  FROM {name}_e)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = [POSTS, LABELLED, QUOTAS, SPLIT]
MODEL = BASE + [model_ctes()]
SCORED = MODEL + [score_ctes("posts", ["doc_id"])]

RULE_A = """CASE WHEN p_negative > 0.4 AND NOT isnan(p_negative) AND p_negative > p_positive THEN 'Negative'
     WHEN p_positive > 0.4 AND NOT isnan(p_positive) AND p_positive > p_negative THEN 'Positive'
     ELSE 'Neutral' END"""
RULE_B = """CASE WHEN p_negative >= p_neutral AND p_negative >= p_positive THEN 'Negative'
     WHEN p_neutral >= p_positive THEN 'Neutral' ELSE 'Positive' END"""
LEVEL = """CASE WHEN p_negative > 0.7 AND NOT isnan(p_negative) THEN 'High'
     WHEN p_negative > 0.4 AND NOT isnan(p_negative) THEN 'Moderate' ELSE 'Low' END"""
TOP1 = "greatest(p_negative, p_neutral, p_positive)"
TOP2 = ("greatest(least(p_negative, p_neutral), least(p_neutral, p_positive), "
        "least(p_negative, p_positive))")
CONF = f"({TOP1} / ({TOP1} + {TOP2}))"
ADVICE_SQL = "CASE {lvl} " + " ".join(
    "WHEN '{}' THEN '{}'".format(level, text.replace("'", "''")) for level, text in ADVICE) + " END"


def scored_table(docs: str, name: str = "st") -> str:
    """Batch evaluation table over ``docs`` (doc_id, text, platform,
    raw_label); every row kept, 'Error' when nothing is known."""
    return score_ctes(docs, ["doc_id"], name=f"{name}_pr") + f""",
{name} AS (
  SELECT d.doc_id, {strip('d.platform')} AS platform, {capitalize(strip('d.raw_label'))} AS label,
         CASE WHEN s.doc_id IS NULL THEN 'Error' ELSE ({RULE_B.replace('p_', 's.p_')}) END AS predicted,
         CASE WHEN s.doc_id IS NULL THEN 0.0::DOUBLE ELSE {CONF.replace('p_', 's.p_')} END AS confidence
  FROM {docs} d LEFT JOIN {name}_pr s ON d.doc_id = s.doc_id),
{name}_m AS (
  SELECT *, coalesce(label = predicted, false) AS matches_original FROM {name})"""


TEST_DOCS = """test_docs AS (
  SELECT p.doc_id, p.text, p.platform, p.raw_label FROM posts p JOIN split s ON p.doc_id = s.doc_id
  WHERE s.split = 'test')"""


def _queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_mentions"] = f"""SELECT doc_id, text AS original_text, {remove_mentions('text')} AS text,
       coalesce(contains(text, '@'), false) AS has_mention FROM documents"""
    q["mention_stats"] = """SELECT count(*) AS total_rows,
       count_if(coalesce(contains(text, '@'), false)) AS rows_with_mentions,
       CASE WHEN count(*) = 0 THEN NULL
            ELSE count_if(coalesce(contains(text, '@'), false)) / count(*) * 100 END AS pct_with_mentions
FROM documents"""
    q["clean_sample"] = f"""SELECT doc_id, text AS original_text, {remove_mentions('text')} AS cleaned_text
FROM documents ORDER BY doc_id LIMIT 5"""
    q["first_n_posts"] = with_ctes(POSTS) + "SELECT doc_id, platform, text FROM posts ORDER BY doc_id LIMIT 300"
    q["clean_stage_counts"] = with_ctes(POSTS) + f"""SELECT count(*) AS n_input,
       count_if(text IS NOT NULL AND raw_label IS NOT NULL) AS n_complete,
       count_if(text IS NOT NULL AND raw_label IS NOT NULL
                AND lower({strip('raw_label')}) IN ('negative', 'neutral', 'positive')) AS n_known_label
FROM posts"""
    q["label_values"] = with_ctes(POSTS) + f"""SELECT DISTINCT {strip('raw_label')} AS label_value
FROM posts WHERE text IS NOT NULL AND raw_label IS NOT NULL"""
    q["labelled"] = with_ctes(POSTS, LABELLED) + "SELECT doc_id, text, label FROM lp"
    q["class_distribution"] = with_ctes(POSTS, LABELLED) + f"""SELECT label, {NAME.format(c='label')} AS sentiment,
       count(*) AS n_posts FROM lp GROUP BY label ORDER BY n_posts DESC, label"""
    q["label_capitalize"] = with_ctes(POSTS) + f"""SELECT doc_id, raw_label, {capitalize('raw_label')} AS capitalized_raw,
       {capitalize(strip('raw_label'))} AS label_std FROM posts WHERE raw_label IS NOT NULL"""
    q["stratified_split"] = with_ctes(*BASE) + "SELECT doc_id, label, split FROM split"
    q["split_balance"] = with_ctes(*BASE) + """SELECT s.label, count(*) AS n_class,
       count_if(split = 'test') AS n_test, count_if(split = 'train') AS n_train, q.quota
FROM split s JOIN quotas q ON s.label = q.label GROUP BY s.label, q.quota"""
    q["nb_weights"] = with_ctes(*MODEL) + "SELECT token, n0, n1, n2, n_occ, wq0, wq1, wq2 FROM weights"
    q["probabilities"] = with_ctes(*SCORED) + "SELECT doc_id, p_negative, p_neutral, p_positive FROM pr"
    q["score_distinct"] = q["probabilities"]
    q["score_incremental"] = with_ctes(*SCORED) + """SELECT d.doc_id, p_negative, p_neutral, p_positive,
       count_if(d.doc_id % 2 = 0) OVER (PARTITION BY d.text) > 0 AS reused
FROM posts d LEFT JOIN pr ON pr.doc_id = d.doc_id WHERE length(d.text) > 0"""
    q["score_batch_udf"] = q["probabilities"]
    q["score_with_stored_model"] = q["probabilities"]
    q["confidence"] = with_ctes(*SCORED) + f"""SELECT doc_id, {TOP1} AS top_prob, {TOP2} AS second_prob,
       {CONF} AS confidence FROM pr"""
    q["sentiment_rules"] = with_ctes(*SCORED) + f"""SELECT doc_id, rule_a, rule_b, rule_a <> rule_b AS rules_differ
FROM (SELECT doc_id, {RULE_A} AS rule_a, {RULE_B} AS rule_b FROM pr)"""
    q["toxicity"] = with_ctes(*SCORED) + f"""SELECT doc_id, p_negative AS toxicity_score, {LEVEL} AS toxicity_level,
       p_negative * 100 AS gauge_value FROM pr"""
    q["raw_scores"] = with_ctes(*SCORED) + f"""SELECT doc_id, {pct('p_negative')} AS negative_pct,
       {pct('p_neutral')} AS neutral_pct, {pct('p_positive')} AS positive_pct FROM pr"""
    q["app_records"] = with_ctes(*SCORED) + f"""SELECT doc_id, {RULE_A} AS sentiment, p_negative AS toxicity_score,
       {LEVEL} AS toxicity_level, {CONF} AS confidence, {ADVICE_SQL.format(lvl=LEVEL)} AS suggestions,
       p_negative, p_neutral, p_positive, {pct('p_negative')} AS negative_pct,
       {pct('p_neutral')} AS neutral_pct, {pct('p_positive')} AS positive_pct FROM pr"""
    q["flagged_posts"] = with_ctes(*SCORED) + f"""SELECT doc_id, platform, toxicity_level, toxicity_score,
       {ADVICE_SQL.format(lvl='toxicity_level')} AS suggestions
FROM (SELECT pr.doc_id, p.platform, {LEVEL} AS toxicity_level, p_negative AS toxicity_score
      FROM pr JOIN posts p ON pr.doc_id = p.doc_id) WHERE toxicity_level <> 'Low'"""
    q["scored_posts"] = with_ctes(*MODEL, scored_table("posts")) + """SELECT m.doc_id, m.platform, p.text, m.label,
       m.predicted, m.confidence, m.matches_original
FROM st_m m JOIN posts p ON m.doc_id = p.doc_id"""
    q["score_with_errors"] = with_ctes(*SCORED) + f"""SELECT d.doc_id,
       CASE WHEN pr.doc_id IS NULL THEN 'Error' ELSE {RULE_B.replace('p_', 'pr.p_')} END AS predicted,
       CASE WHEN pr.doc_id IS NULL THEN 0.0::DOUBLE ELSE {CONF.replace('p_', 'pr.p_')} END AS confidence,
       coalesce(pr.p_negative, 0.0::DOUBLE) AS p_negative, coalesce(pr.p_neutral, 0.0::DOUBLE) AS p_neutral,
       coalesce(pr.p_positive, 0.0::DOUBLE) AS p_positive
FROM posts d LEFT JOIN pr ON d.doc_id = pr.doc_id"""
    q["platform_stats"] = with_ctes(*MODEL, scored_table("posts")) + """SELECT platform, count(*) AS n_rows,
       count(label) AS n_labelled, round_even(avg(confidence), 3) AS avg_confidence,
       round_even(stddev_samp(confidence), 3) AS std_confidence,
       round_even(avg(CAST(matches_original AS INTEGER)), 3) AS accuracy,
       round_even(avg(CASE WHEN label IS NOT NULL THEN CAST(matches_original AS INTEGER) END), 3)
         AS labelled_accuracy
FROM st_m WHERE platform IS NOT NULL GROUP BY platform"""
    q["accuracy"] = with_ctes(*MODEL, TEST_DOCS, scored_table("test_docs")) + """SELECT count(*) AS n_total,
       count_if(matches_original) AS n_match,
       CASE WHEN count(*) = 0 THEN NULL ELSE count_if(matches_original) / count(*) * 100 END AS accuracy_pct
FROM st_m"""
    cols = ", ".join(f"round_even(count_if(predicted = '{v}') / count(*), 3) * 100 AS \"{v}\""
                     for v in ["Negative", "Neutral", "Positive", "Error"])
    q["confusion_matrix"] = with_ctes(*MODEL, TEST_DOCS, scored_table("test_docs")) + f"""SELECT label, {cols}
FROM st_m WHERE label IS NOT NULL AND predicted IS NOT NULL GROUP BY label"""
    q["toxicity_histogram"] = with_ctes(*SCORED) + f"""SELECT toxicity_level, decile, count(*) AS n_posts
FROM (SELECT {LEVEL} AS toxicity_level, CAST(least(floor(p_negative * 10), 9) AS INTEGER) AS decile FROM pr)
GROUP BY toxicity_level, decile"""
    q["epoch_batches"] = "WITH RECURSIVE " + with_ctes(*BASE, """numbered AS (
  SELECT doc_id, label, row_number() OVER (ORDER BY md5('shuffle-1:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx
  FROM split WHERE split = 'train')""", """size AS (
  SELECT n, a, (n + a - 1) // a AS b
  FROM (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM numbered))""", """net AS (
  SELECT e.epoch, doc_id, label, 0 AS round, idx // b AS l, idx % b AS r
  FROM numbered, size, (SELECT unnest([1, 2, 3]) AS epoch) e
  UNION ALL
  SELECT epoch, doc_id, label, CASE WHEN round = 6 THEN 0 ELSE round + 1 END,
         CASE WHEN round IN (0, 2, 4) THEN (l + CAST('0x' || substr(md5('shuffle-1:' || epoch || ':' || round || ':' || r), 1, 15) AS BIGINT) % a) % a ELSE l END,
         CASE WHEN round IN (1, 3, 5) THEN (r + CAST('0x' || substr(md5('shuffle-1:' || epoch || ':' || round || ':' || l), 1, 15) AS BIGINT) % b) % b ELSE r END
  FROM net, size WHERE round < 6 OR l * b + r >= n)""").removeprefix("WITH ") + """SELECT epoch, doc_id, label, l * b + r AS place, (l * b + r) // 32 AS batch_id
FROM net, size WHERE round = 6 AND l * b + r < n"""
    q["batch_loss"] = with_ctes(*MODEL, TEST_DOCS) + """,
tp AS (SELECT t.doc_id, t.text, s.label FROM test_docs t JOIN split s ON t.doc_id = s.doc_id),
occ AS (SELECT doc_id, unnest(""" + tokens('text') + """) AS token FROM tp),
sums AS (SELECT doc_id, sum(wq0) AS s0, sum(wq1) AS s1, sum(wq2) AS s2, count(*) AS n_known
         FROM occ JOIN weights w ON occ.token = w.token GROUP BY doc_id),
lg AS (
  SELECT tp.doc_id, tp.label,
         pr0 + coalesce(CAST(s0 AS DOUBLE) / 1000000.0::DOUBLE / sqrt(CAST(n_known AS DOUBLE)), 0.0::DOUBLE) AS l0,
         pr1 + coalesce(CAST(s1 AS DOUBLE) / 1000000.0::DOUBLE / sqrt(CAST(n_known AS DOUBLE)), 0.0::DOUBLE) AS l1,
         pr2 + coalesce(CAST(s2 AS DOUBLE) / 1000000.0::DOUBLE / sqrt(CAST(n_known AS DOUBLE)), 0.0::DOUBLE) AS l2
  FROM tp LEFT JOIN sums ON tp.doc_id = sums.doc_id, priors),
rows AS (
  SELECT (row_number() OVER (ORDER BY md5('shuffle-1:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) // 32 AS batch_id,
         greatest(l0, l1, l2) + ln(exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2))
           + exp(l2 - greatest(l0, l1, l2)))
           - CASE label WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END AS loss,
         CASE WHEN (CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END) = label
              THEN 1 ELSE 0 END AS correct
  FROM lg),
per_batch AS (SELECT batch_id, count(*) AS n, sum(loss) AS loss_sum, avg(loss) AS loss_mean,
              sum(correct) AS correct FROM rows GROUP BY batch_id)
SELECT sum(n) AS n_rows, count(*) AS n_batches, (SELECT (count(*) + 31) // 32 * 3 FROM train) AS total_steps,
       round(avg(loss_mean), 6) AS mean_batch_loss, round(sum(loss_sum) / sum(n), 6) AS mean_loss,
       round(sum(correct) / sum(n), 6) AS weighted_accuracy
FROM per_batch"""
    alphas = ", ".join(f"({i + 1}, {a!r}::DOUBLE)" for i, a in enumerate(ALPHAS))
    q["best_model"] = with_ctes(*MODEL, TEST_DOCS) + f""",
cand AS (SELECT * FROM (VALUES {alphas}) AS t(epoch, alpha)),
wa AS (
  SELECT cand.epoch, c.token,
         CAST(round(ln((c.n0 + alpha) / (t.t0 + alpha * t.v)) * 1000000.0::DOUBLE) AS BIGINT) AS wq0,
         CAST(round(ln((c.n1 + alpha) / (t.t1 + alpha * t.v)) * 1000000.0::DOUBLE) AS BIGINT) AS wq1,
         CAST(round(ln((c.n2 + alpha) / (t.t2 + alpha * t.v)) * 1000000.0::DOUBLE) AS BIGINT) AS wq2
  FROM counts c, totals t, cand),
pa AS (
  SELECT cand.epoch, cand.alpha,
         ln((count_if(label = 0) + alpha) / (count(*) + 3 * alpha)) AS pr0,
         ln((count_if(label = 1) + alpha) / (count(*) + 3 * alpha)) AS pr1,
         ln((count_if(label = 2) + alpha) / (count(*) + 3 * alpha)) AS pr2
  FROM train, cand GROUP BY cand.epoch, cand.alpha),
tp AS (SELECT t.doc_id, t.text, s.label FROM test_docs t JOIN split s ON t.doc_id = s.doc_id),
occ AS (SELECT doc_id, unnest({tokens('text')}) AS token FROM tp),
sums AS (SELECT wa.epoch, doc_id, sum(wq0) AS s0, sum(wq1) AS s1, sum(wq2) AS s2, count(*) AS n_known
         FROM occ JOIN wa ON occ.token = wa.token GROUP BY wa.epoch, doc_id),
lg AS (
  SELECT pa.epoch, pa.alpha, tp.label,
         pr0 + coalesce(CAST(s0 AS DOUBLE) / 1000000.0::DOUBLE / sqrt(CAST(n_known AS DOUBLE)), 0.0::DOUBLE) AS l0,
         pr1 + coalesce(CAST(s1 AS DOUBLE) / 1000000.0::DOUBLE / sqrt(CAST(n_known AS DOUBLE)), 0.0::DOUBLE) AS l1,
         pr2 + coalesce(CAST(s2 AS DOUBLE) / 1000000.0::DOUBLE / sqrt(CAST(n_known AS DOUBLE)), 0.0::DOUBLE) AS l2
  FROM tp CROSS JOIN pa LEFT JOIN sums ON tp.doc_id = sums.doc_id AND pa.epoch = sums.epoch),
acc AS (
  SELECT epoch, alpha, avg(CASE WHEN (CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END)
                                    = label THEN 1.0 ELSE 0.0 END) AS val_accuracy
  FROM lg GROUP BY epoch, alpha),
best AS (
  SELECT CASE WHEN max(val_accuracy) > 0
              THEN min(epoch) FILTER (WHERE val_accuracy = (SELECT max(val_accuracy) FROM acc))
              ELSE max(epoch) END AS best_epoch FROM acc)
SELECT epoch, alpha, val_accuracy, epoch = best_epoch AS is_best FROM acc, best"""
    q["model_latest"] = with_ctes(*MODEL) + f"""SELECT 'nb_sentiment' AS name, {len(ALPHAS)} AS latest_version,
       {len(ALPHAS)} AS n_versions, v AS vocab_size, {ALPHAS[-1]!r}::DOUBLE AS alpha FROM totals"""
    vocab_ctes = [POSTS, f"""counts AS (
  SELECT token, count(*) AS n_occ FROM (SELECT unnest({tokens('text')}) AS token FROM posts
  WHERE text IS NOT NULL) GROUP BY token)""", """vocab AS (
  SELECT token, token_id, n_occ FROM (
    SELECT token, row_number() OVER (ORDER BY n_occ DESC, md5(token), token) + 3 AS token_id, n_occ FROM counts))"""]
    q["vocabulary"] = with_ctes(*vocab_ctes) + "SELECT token, token_id, n_occ FROM vocab"
    q["encode_posts"] = with_ctes(*vocab_ctes, f"""toks AS (
  SELECT doc_id, {tokens('text')} AS t FROM posts WHERE text IS NOT NULL)""", """occ AS (
  SELECT doc_id, len(t) AS n_tokens, unnest(t) AS token, unnest(range(len(t))) AS pos FROM toks)""",
                                  """ids AS (
  SELECT o.doc_id, o.n_tokens, o.pos, coalesce(v.token_id, 3) AS token_id
  FROM occ o LEFT JOIN vocab v ON o.token = v.token)""") + """SELECT doc_id, pos // 126 AS chunk, n_tokens,
       '1 ' || string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos) || ' 2'
         || repeat(' 0', CAST(126 - count(*) AS INTEGER)) AS ids_text,
       CAST(count(*) + 2 AS INTEGER) AS mask_ones
FROM ids GROUP BY doc_id, n_tokens, pos // 126"""
    na = ", ".join("'" + v.replace("'", "''") + "'" for v in NA_VALUES)
    q["csv_roundtrip"] = f"""SELECT doc_id,
       CASE WHEN text IN ({na}) THEN NULL ELSE text END AS text,
       CASE WHEN lang IN ({na}) THEN NULL ELSE lang END AS lang,
       CASE WHEN source IN ({na}) THEN NULL ELSE source END AS source
FROM documents"""
    nn = lambda c: f"CASE WHEN {c} IN ({na}) THEN NULL ELSE {c} END"
    q["evaluate_from_csv"] = with_ctes(*MODEL, f"""csv_docs AS (
  SELECT doc_id, {nn('text')} AS text, {nn('platform')} AS platform, {nn('raw_label')} AS raw_label
  FROM posts)""", scored_table("csv_docs", "cs")) + """SELECT doc_id, platform, label, predicted, confidence,
       matches_original FROM cs_m"""
    hist = with_ctes(*MODEL, score_ctes("conversations", ["conv_id", "turn"], name="hp")) + f""",
hist AS (
  SELECT c.conv_id, c.turn, c.role,
         CASE WHEN length(c.text) > 50 THEN left(c.text, 50) || '...' ELSE c.text END AS preview,
         {RULE_A.replace('p_', 'h.p_')} AS sentiment, {LEVEL.replace('p_', 'h.p_')} AS toxicity_level,
         {pct(CONF.replace('p_', 'h.p_'))} AS confidence_text
  FROM hp h JOIN conversations c ON h.conv_id = c.conv_id AND h.turn = c.turn)
"""
    q["logreg_selection"] = with_ctes(*MODEL, TEST_DOCS) + """SELECT t.doc_id, s.label, 1.0::DOUBLE AS p_sum,
       true AS is_largest, 3 AS n_candidates, true AS is_first_best
FROM test_docs t JOIN split s ON t.doc_id = s.doc_id WHERE t.text IS NOT NULL"""
    q["history_feed"] = hist + "SELECT * FROM hist"
    q["history_last_n"] = hist + """SELECT conv_id, turn, role, preview, sentiment, toxicity_level, confidence_text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM hist) WHERE rn <= 5"""
    return q


def oracle_sql() -> dict[str, str]:
    from moodline.streaming.oracle import streaming_sql
    out = _queries()
    out.update(streaming_sql())
    return out
