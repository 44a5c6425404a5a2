"""DuckDB oracle SQL for every `queries()` key.

The fixture views are rebuilt here as CTEs with the same integer formulas the
Spark fixtures use (FIXTURES.md §3), over the pre-registered driver views.
Doubles are rounded in both engines with the same expression order.
"""

from __future__ import annotations

from vocspark import config as C
from vocspark.sources.fixtures import SEGMENT_TIER

AS_OF = C.DEFAULT_AS_OF


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _tier_case(col: str) -> str:
    parts = " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in SEGMENT_TIER.items())
    return f"(CASE {col} {parts} END)"


def _tier_weight_case(tier_sql: str) -> str:
    parts = " ".join(f"WHEN '{t}' THEN {w}" for t, w in C.TIER_WEIGHTS.items())
    return f"(CASE lower({tier_sql}) {parts} ELSE 1.0 END)"


def fx_classified_cte() -> str:
    tier = _tier_case("c.c_mktsegment")
    weight = f"round({_tier_weight_case(tier)} * (CASE WHEN c.c_acctbal > 0 THEN 1.0 + ln(1.0 + c.c_acctbal / 100.0) ELSE 1.0 END), 2)"
    return f"""fx_classified AS (
  SELECT *, CAST(round(CAST(severity AS DECIMAL(12,2)) * CAST(value_weight AS DECIMAL(12,2)), 2) AS DOUBLE) AS financial_impact FROM (
  SELECT
    'review of order ' || lpad(CAST(l.l_orderkey AS VARCHAR), 12, '0') || ', line ' || lpad(CAST(l.l_linenumber AS VARCHAR), 2, '0')
      || ', part ' || lpad(CAST(l.l_partkey AS VARCHAR), 10, '0') || ', supplier ' || lpad(CAST(l.l_suppkey AS VARCHAR), 10, '0') AS text,
    ({_sql_list(C.ALL_LABELS)})[CAST(l.l_partkey % 13 AS INTEGER) + 1] AS category,
    strftime(l.l_shipdate, '%Y-%m') AS date,
    2.0 + 0.5 * (l.l_quantity % 7.0) AS severity,
    {weight} AS value_weight,
    round(10.0 * l.l_discount, 4) AS confidence,
    'v' || CAST(o.o_custkey % 9 AS VARCHAR) AS app_version,
    o.o_custkey % 20 AS upvotes,
    l.l_shipdate AS "at",
    l.l_quantity,
    l.l_linenumber,
    {tier} AS user_tier
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE (l.l_partkey + 7 * l.l_suppkey + l.l_linenumber) % 24
        < 4 + ((l.l_partkey % 13) * (12 * year(l.l_shipdate) + month(l.l_shipdate))) % 13
  ) q
)"""


def fx_timeseries_cte(src: str = "fx_classified", name: str = "fx_timeseries", g: str = "fx_g") -> str:
    return f"""{g} AS (
  SELECT category AS issue_label, date AS month, count(*) AS mentions,
         sum(severity) AS sev_sum, sum(CAST(financial_impact AS DECIMAL(18,2))) AS impact_sum
  FROM {src} WHERE date IS NOT NULL AND date <> '' GROUP BY 1, 2
),
{name} AS (
  SELECT issue_label AS topic_id, issue_label, month, CAST(mentions AS BIGINT) AS mentions,
    round(mentions / greatest(tot, 1) * 1000, 2) AS normalized_rate,
    round(sev_sum / greatest(tot, 1) * 1000, 2) AS severity_weighted_rate,
    round(CAST(impact_sum AS DOUBLE) / greatest(tot, 1) * 1000, 2) AS revenue_risk_score,
    CAST(tot AS BIGINT) AS total_reviews_in_month
  FROM (SELECT *, sum(mentions) OVER (PARTITION BY month) AS tot FROM {g}) x
)"""


def fx_topics_cte() -> str:
    return """fx_ev AS (
  SELECT label, list(t ORDER BY rk) AS sample_reviews FROM (
    SELECT category AS label, text AS t,
           row_number() OVER (PARTITION BY category ORDER BY confidence DESC, text ASC) AS rk
    FROM fx_classified WHERE length(text) > 40) e
  WHERE rk <= 15 GROUP BY label
),
fx_topics AS (
  SELECT s.label AS topic_id, s.label AS keywords, s.label, CAST(s.mentions AS BIGINT) AS mentions,
         s.avg_severity, coalesce(e.sample_reviews, []) AS sample_reviews
  FROM (SELECT category AS label, count(*) AS mentions, round(avg(severity), 2) AS avg_severity
        FROM fx_classified GROUP BY 1) s
  LEFT JOIN fx_ev e ON s.label = e.label
)"""


def with_fixtures(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def base_ctes() -> list[str]:
    return [fx_classified_cte(), fx_timeseries_cte(), fx_topics_cte()]


def month_window_cte(n: int, mode: str = "none", src: str = "fx_timeseries", name: str = "mw") -> str:
    """SQL twin of operators.series.month_window."""
    if n <= 0:
        period = "CASE WHEN rk = 1 THEN 'cur' WHEN rk = 2 THEN 'prev' END" if mode == "last_month" else "'cur'"
    else:
        if mode == "rest":
            prev = f"CASE WHEN nm >= {2*n} THEN rk > {n} AND rk <= {2*n} ELSE rk > {n} END"
        elif mode == "last_month":
            prev = f"CASE WHEN nm >= {2*n} THEN rk > {n} AND rk <= {2*n} ELSE rk = 2 END"
        else:
            prev = f"rk > {n} AND rk <= {2*n} AND nm >= {2*n}"
        period = f"CASE WHEN rk <= {n} THEN 'cur' WHEN {prev} THEN 'prev' END"
    return f"""{name} AS (
  SELECT month, period FROM (
    SELECT month, {period} AS period FROM (
      SELECT month, row_number() OVER (ORDER BY month DESC) AS rk, count(*) OVER () AS nm
      FROM (SELECT DISTINCT month FROM {src} WHERE month IS NOT NULL) d) r) p
  WHERE period IS NOT NULL
)"""


def velocity_sql(cur: str, prev: str) -> tuple[str, str, str]:
    pct = f"round(({cur} - {prev}) / {prev} * 100, 1)"
    v = f"CASE WHEN {prev} > 0 THEN {pct} END"
    d = (f"CASE WHEN {prev} > 0 THEN (CASE WHEN {pct} > 5 THEN 'up' WHEN {pct} < -5 THEN 'down' ELSE 'same' END) "
         f"WHEN {cur} > 0 THEN 'new' ELSE 'same' END")
    lab = (f"CASE WHEN {prev} > 0 THEN (CASE WHEN {pct} > 0 THEN '+' ELSE '' END) || "
           f"CAST(CAST({pct} AS DECIMAL(20,1)) AS VARCHAR) || '%' WHEN {cur} > 0 THEN 'NEW' ELSE '' END")
    return v, d, lab


def top_issues_sql(n: int, top: int = 10) -> str:
    if n > 0:
        v, d, lab = velocity_sql("mentions", "prev0")
        body = f"""
, tot AS (
  SELECT issue_label,
         sum(CASE WHEN period = 'cur' THEN mentions END) AS cur,
         sum(CASE WHEN period = 'prev' THEN mentions END) AS prev,
         max(CASE WHEN period = 'cur' THEN revenue_risk_score END) AS peak
  FROM fx_timeseries JOIN mw USING (month) GROUP BY issue_label
), tot2 AS (
  SELECT *, cur IS NOT NULL AND cur >= greatest(2, CAST(floor(sum(cur) OVER () * 0.05) AS BIGINT)) AS valid,
         bool_or(prev IS NOT NULL) OVER () AS hp0
  FROM tot
), j AS (
  SELECT t.label AS issue, CAST(coalesce(x.cur, 0) AS BIGINT) AS mentions,
         CAST(coalesce(CASE WHEN x.valid THEN x.peak END, 0.0) AS DOUBLE) AS sort_metric,
         round(t.avg_severity, 2) AS avg_severity,
         coalesce(x.prev, 0) AS prev0,
         bool_or(coalesce(x.hp0, false)) OVER () AS hp
  FROM fx_topics t LEFT JOIN tot2 x ON t.label = x.issue_label
), out AS (
  SELECT issue, mentions, sort_metric, avg_severity, round(sort_metric, 2) AS revenue_risk,
         CASE WHEN hp THEN {v} END AS velocity,
         CASE WHEN hp THEN {d} ELSE 'same' END AS velocity_dir,
         CASE WHEN hp THEN {lab} ELSE '' END AS velocity_label
  FROM j WHERE mentions <> 0
)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY sort_metric DESC, issue ASC) AS rank FROM out) r
WHERE rank <= {top}"""
        return "WITH " + ",\n".join(base_ctes() + [month_window_cte(n)]) + body
    body = f"""
, risk AS (SELECT issue_label AS issue, CAST(sum(CAST(revenue_risk_score AS DECIMAL(20,2))) AS DOUBLE) AS risk
           FROM fx_timeseries GROUP BY 1),
out AS (
  SELECT t.label AS issue, CAST(t.mentions AS BIGINT) AS mentions, CAST(t.mentions AS DOUBLE) AS sort_metric,
         round(t.avg_severity, 2) AS avg_severity, round(coalesce(r.risk, 0.0), 2) AS revenue_risk,
         CAST(NULL AS DOUBLE) AS velocity, 'same' AS velocity_dir, '' AS velocity_label
  FROM fx_topics t LEFT JOIN risk r ON t.label = r.issue WHERE t.mentions <> 0
)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY sort_metric DESC, issue ASC) AS rank FROM out) r
WHERE rank <= {top}"""
    return "WITH " + ",\n".join(base_ctes()) + body


def monthly_rates_sql() -> str:
    return "WITH " + ",\n".join(base_ctes()) + "\nSELECT * FROM fx_timeseries"


def topic_stats_sql() -> str:
    return "WITH " + ",\n".join(base_ctes()) + "\nSELECT * FROM fx_topics"


def fx_reviews_cte() -> str:
    tier = _tier_case("c.c_mktsegment")
    sc = "(1 + (7 * o.o_orderkey + o.o_custkey) % 5)"
    return f"""fx_reviews AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS reviewId, d.text AS content, d.lang,
         CAST({sc} AS INTEGER) AS score,
         CASE WHEN {sc} <= 2 THEN 'negative' ELSE 'positive' END AS sentiment,
         o.o_orderdate AS "at", {tier} AS user_tier, c.c_acctbal AS clv,
         'v' || CAST(o.o_custkey % 9 AS VARCHAR) AS appVersion,
         CAST(o.o_custkey % 20 AS INTEGER) AS thumbsUpCount, 'fixture' AS app, d.doc_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
)"""


def _run_of_five() -> str:
    """F7 without back-references: any character but newline five times in a row, written out for
    each character up to U+024F and for those in use beyond (RE2 reads each text once)."""
    points = [c for c in [*range(9, 0x250), *range(0x2010, 0x2040), 0x20AC] if c not in (10, 13, 0x2028, 0x2029) and not 0x7F <= c < 0xA0]
    return "|".join(f"\\x{{{c:x}}}{{5}}" for c in points)


_RUN_OF_FIVE = _run_of_five()


def valid_doc_sql(text: str = "text", lang: str | None = "lang") -> str:
    """SQL twin of functions.text.is_valid_review, evaluated per row of `docs`."""
    pats = " OR ".join(f"regexp_matches(lower(t), '{p}')" for p in C.CANNED_PATTERNS)
    lang_pred = f"AND coalesce({lang}, '') = 'en'" if lang else ""
    return f"""(
  {text} IS NOT NULL AND length(t) >= 15 AND nw >= 3 {lang_pred}
  AND NOT ({pats})
  AND NOT regexp_matches(lower(t), '{_RUN_OF_FIVE}')
  AND NOT (nw > 4 AND maxc / nw > 0.5)
)"""


def docs_valid_cte(src: str = "documents", key: str = "doc_id", text: str = "text", lang: str | None = "lang",
                   name: str = "docs_valid") -> str:
    lang_col = f", {lang}" if lang else ""
    return f"""{name}_w AS (
  SELECT {key}, {text}{lang_col}, regexp_replace({text}, '^\\s+|\\s+$', '', 'g') AS t,
         list_filter(regexp_split_to_array(regexp_replace({text}, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda x: x <> '') AS ws
  FROM {src}
),
{name}_c AS (
  SELECT {key}, max(c) AS maxc FROM (
    SELECT {key}, w, count(*) AS c FROM (SELECT {key}, lower(unnest(ws)) AS w FROM {name}_w) u GROUP BY 1, 2) g
  GROUP BY 1
),
{name} AS (
  SELECT w.{key}, coalesce({valid_doc_sql(text, lang)}, false) AS is_valid
  FROM (SELECT *, len(ws) AS nw FROM {name}_w) w LEFT JOIN {name}_c c ON w.{key} = c.{key}
)"""


def period_cte(n: int, src: str = "fx_reviews", name: str = "p") -> str:
    if n <= 0:
        return f"{name} AS (SELECT *, 'cur' AS period FROM {src})"
    c1 = f"TIMESTAMP '{AS_OF}' - INTERVAL {n} MONTH"
    c2 = f"TIMESTAMP '{AS_OF}' - INTERVAL {2*n} MONTH"
    return (f"{name} AS (SELECT *, CASE WHEN \"at\" >= {c1} THEN 'cur' ELSE 'prev' END AS period "
            f"FROM {src} WHERE \"at\" >= {c2})")


def review_stats_cte(n: int) -> str:
    return period_cte(n) + """,
rs AS (
  SELECT count(*) FILTER (WHERE period = 'cur') AS n_cur, count(*) FILTER (WHERE period = 'prev') AS n_prev,
         avg(CASE WHEN period = 'cur' THEN score END) AS avg_cur, avg(CASE WHEN period = 'prev' THEN score END) AS avg_prev,
         count(*) FILTER (WHERE period = 'cur' AND sentiment = 'positive') AS pos_cur,
         count(*) FILTER (WHERE period = 'cur' AND sentiment = 'negative') AS neg_cur,
         count(*) FILTER (WHERE period = 'prev' AND sentiment = 'positive') AS pos_prev,
         count(*) FILTER (WHERE period = 'prev' AND sentiment = 'negative') AS neg_prev
  FROM p
)"""


def sentiment_distribution_sql(n: int) -> str:
    return "WITH " + ",\n".join([fx_reviews_cte(), review_stats_cte(n)]) + """
SELECT CAST(pos_cur AS BIGINT) AS positive, CAST(neg_cur AS BIGINT) AS negative,
  CASE WHEN n_prev > 0 THEN round(
    (CASE WHEN pos_cur + neg_cur > 0 THEN pos_cur / (pos_cur + neg_cur) * 100 ELSE 0.0 END) -
    (CASE WHEN pos_prev + neg_prev > 0 THEN pos_prev / (pos_prev + neg_prev) * 100 ELSE 0.0 END), 1)
  ELSE 0.0 END AS momentum
FROM rs"""


def window_totals_cte(key: str, value: str, mw: str = "mw", src: str = "fx_timeseries", name: str = "wt") -> str:
    return f"""{name} AS (
  SELECT {key},
    sum(CASE WHEN period = 'cur' THEN {value} END) AS cur,
    sum(CASE WHEN period = 'prev' THEN {value} END) AS prev,
    max(CASE WHEN period = 'cur' THEN {value} END) AS cur_max,
    max(CASE WHEN period = 'prev' THEN {value} END) AS prev_max,
    count(*) FILTER (WHERE period = 'cur') AS n_cur,
    count(*) FILTER (WHERE period = 'prev') AS n_prev
  FROM {src} JOIN {mw} USING (month) GROUP BY {key}
)"""


def kpis_sql(n: int) -> str:
    ctes = base_ctes() + [fx_reviews_cte(), review_stats_cte(n), month_window_cte(n),
                          window_totals_cte("issue_label", "mentions")]
    dated = n > 0
    win = f"Last {n}M" if dated else "All Time"
    body = f"""
, act AS (
  SELECT count(*) FILTER (WHERE cur > 0) AS active_cur,
         CASE WHEN count(*) FILTER (WHERE n_prev > 0) > 0 THEN count(*) FILTER (WHERE prev > 0) END AS active_prev
  FROM wt
), k AS (
  SELECT rs.*, round(avg_cur, 2) AS avg_c, round(avg_prev, 2) AS avg_p,
    CASE WHEN n_cur > 0 THEN round(pos_cur / n_cur * 100, 1) ELSE 0.0 END AS pp_c,
    CASE WHEN n_prev > 0 THEN round(pos_prev / n_prev * 100, 1) ELSE 0.0 END AS pp_p,
    act.active_cur, act.active_prev
  FROM rs, act
)
SELECT CAST(n_cur AS BIGINT) AS total_reviews, avg_c AS avg_rating, pp_c AS positive_pct,
  CAST(active_cur AS BIGINT) AS active_issues, '{win}' AS window,
  CAST({"CASE WHEN n_prev > 0 THEN round((n_cur - n_prev) / n_prev * 100, 1) END" if dated else "NULL"} AS DOUBLE) AS delta_reviews,
  CAST({"CASE WHEN n_prev > 0 AND avg_c <> 0 AND avg_p <> 0 THEN round(avg_c - avg_p, 2) END" if dated else "NULL"} AS DOUBLE) AS delta_rating,
  CAST({"CASE WHEN n_prev > 0 AND pp_p <> 0 THEN round(pp_c - pp_p, 2) END" if dated else "NULL"} AS DOUBLE) AS delta_positive_pct,
  CAST({"CASE WHEN active_prev IS NOT NULL AND active_prev <> 0 THEN active_cur - active_prev END" if dated else "NULL"} AS BIGINT) AS delta_active_issues
FROM k"""
    return "WITH " + ",\n".join(ctes) + body


def _aspect_map_values() -> str:
    rows = ", ".join(f"('{a}', '{lab}')" for a, labs in C.ASPECT_MAP.items() for lab in labs)
    return f"amap(aspect, issue_label) AS (VALUES {rows})"


def _order_case(col: str, names) -> str:
    parts = " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(names))
    return f"(CASE {col} {parts} ELSE {len(names)} END)"


def aspects_map_sql(n: int) -> str:
    ctes = base_ctes() + [month_window_cte(n, "rest"), window_totals_cte("issue_label", "mentions"), _aspect_map_values()]
    body = f"""
, j AS (
  SELECT a.aspect, a.issue_label, t.cur, t.prev, s.avg_severity
  FROM amap a LEFT JOIN wt t ON a.issue_label = t.issue_label LEFT JOIN fx_topics s ON s.label = a.issue_label
  WHERE a.aspect <> '{C.GENERAL_ASPECT}'
), g AS (
  SELECT aspect, sum(coalesce(cur, 0)) AS mentions,
    CAST(sum(CAST(coalesce(cur, 0) AS DECIMAL(20,0)) * CAST(coalesce(avg_severity, 2.0) AS DECIMAL(10,2))) AS DOUBLE) AS wsum,
    sum(coalesce(prev, 0)) AS prev_vol
  FROM j GROUP BY aspect
), top AS (
  SELECT aspect, issue_label AS top_topic FROM (
    SELECT aspect, issue_label, row_number() OVER (PARTITION BY aspect ORDER BY cur DESC, issue_label) AS r
    FROM j WHERE cur IS NOT NULL) x WHERE r = 1
), out AS (
  SELECT g.aspect, CAST(mentions AS BIGINT) AS mentions, round(wsum / greatest(mentions, 1), 2) AS sentiment_score,
    CASE WHEN prev_vol > 0 THEN round((mentions - prev_vol) / greatest(prev_vol, 1) * 100, 1) ELSE 100.0 END AS momentum_pct,
    coalesce(top_topic, 'None') AS top_topic, {_order_case("g.aspect", list(C.ASPECT_MAP.keys()))} AS ord
  FROM g LEFT JOIN top ON g.aspect = top.aspect
)
SELECT aspect, mentions, sentiment_score, momentum_pct, top_topic,
       row_number() OVER (ORDER BY mentions DESC, ord) AS rank FROM out"""
    return "WITH " + ",\n".join(ctes) + body


FX_ASPECTS = None


def _fx_aspect_keywords():
    from vocspark.sources.fixtures import FX_ASPECT_KEYWORDS
    return FX_ASPECT_KEYWORDS


def fx_aspect_analysis_ctes() -> list[str]:
    kw = _fx_aspect_keywords()
    hits = " UNION ALL ".join(
        f"SELECT '{a}' AS aspect, count(*) FILTER (WHERE " + " OR ".join(f"contains(lower(content), '{w}')" for w in ws)
        + ") AS mentions FROM nv" for a, ws in kw.items())
    return [fx_reviews_cte(), docs_valid_cte(),
            "nv AS (SELECT r.* FROM fx_reviews r JOIN docs_valid v ON r.doc_id = v.doc_id "
            "WHERE r.sentiment = 'negative' AND v.is_valid)",
            f"fx_aspect_analysis AS (SELECT aspect, CAST(mentions AS BIGINT) AS mentions FROM ({hits}) h)"]


def aspect_mentions_sql() -> str:
    return "WITH " + ",\n".join(fx_aspect_analysis_ctes()) + "\nSELECT * FROM fx_aspect_analysis"


def threshold_alerts_sql() -> str:
    return "WITH " + ",\n".join(fx_aspect_analysis_ctes()) + f"""
, x AS (SELECT *, mentions / sum(mentions) OVER () * 100 AS pct FROM fx_aspect_analysis)
SELECT 'alert_' || CAST(CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) AS VARCHAR) || '_' || aspect AS id,
  'aspect_spike' AS type, aspect AS category,
  printf('Critical spike detected in %s (%.1f%% of complaints).', aspect, pct) AS message,
  'high' AS severity, TIMESTAMP '{AS_OF}' AS timestamp
FROM x WHERE pct IS NOT NULL AND pct >= {C.SHARE_ALERT_PCT}"""


def _metric_for(metric: str) -> str:
    return "revenue_risk_score" if metric == "revenue" else "severity_weighted_rate"


def trending_ctes(n: int, metric: str = "severity", top: int = 5) -> list[str]:
    m = _metric_for(metric)
    thr = "greatest(2, CAST(floor(tot * 0.05) AS BIGINT))" if n > 0 else "15"
    return base_ctes() + [month_window_cte(n), f"""cur AS (SELECT month FROM mw WHERE period = 'cur'),
sums AS (SELECT issue_label, sum(mentions) AS m, max({m}) AS peak FROM fx_timeseries JOIN cur USING (month) GROUP BY 1),
valid AS (SELECT * FROM (SELECT *, sum(m) OVER () AS tot FROM sums) s WHERE m >= {thr}),
top5 AS (SELECT issue_label FROM (SELECT issue_label, row_number() OVER (ORDER BY peak DESC, issue_label) AS r FROM valid) v
         WHERE r <= {top}),
bounds AS (SELECT min(month) AS m0, max(month) AS m1 FROM fx_timeseries),
grid AS (SELECT t.issue_label, strftime(unnest(generate_series(CAST(b.m0 || '-01' AS DATE), CAST(b.m1 || '-01' AS DATE),
                INTERVAL 1 MONTH)), '%Y-%m') AS month FROM top5 t, bounds b),
vals AS (SELECT issue_label, month, avg({m}) AS v FROM fx_timeseries GROUP BY 1, 2),
g2 AS (SELECT grid.issue_label, grid.month, vals.v FROM grid LEFT JOIN vals
       ON grid.issue_label = vals.issue_label AND grid.month = vals.month),
bands AS (
  SELECT issue_label, month, v AS raw,
    coalesce(CASE WHEN count(v) OVER w >= 2 THEN round(avg(CAST(round(v * 100) AS BIGINT)) OVER w, 0) / 100.0 END, 0.0) AS value,
    coalesce(round(CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w + 1.5 * stddev_samp(v) OVER w END, 2), 0.0) AS upper_bound,
    coalesce(round(CASE WHEN lag(v) OVER w2 <> 0 THEN (v - lag(v) OVER w2) / lag(v) OVER w2 * 100 END, 1), 0.0) AS mom_pct
  FROM g2
  WINDOW w AS (PARTITION BY issue_label ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),
         w2 AS (PARTITION BY issue_label ORDER BY month)
)"""]


def corr_best_cte(src: str, key: str, month: str, val: str, thr: float, name: str = "best") -> str:
    return f"""{name}_pairs AS (
  SELECT a.{key} AS a, b.{key} AS b,
    CASE WHEN stddev_pop(a.{val}) * stddev_pop(b.{val}) = 0 THEN NULL
         ELSE covar_pop(a.{val}, b.{val}) / (stddev_pop(a.{val}) * stddev_pop(b.{val})) END AS r
  FROM {src} a JOIN {src} b ON a.{month} = b.{month} AND a.{key} <> b.{key} GROUP BY 1, 2
),
{name} AS (
  SELECT a, b, r FROM (
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) AS rn
    FROM {name}_pairs WHERE r IS NOT NULL AND NOT isnan(r)) x
  WHERE rn = 1 AND r > {thr}
)"""


def trending_sql(n: int, metric: str = "severity") -> str:
    ctes = trending_ctes(n, metric) + [corr_best_cte("bands", "issue_label", "month", "value", C.CORR_TRENDING)]
    tgt = "SELECT * FROM bands WHERE month IN (SELECT month FROM cur)" if n > 0 else "SELECT * FROM bands"
    body = f"""
, bc AS (
  SELECT bands.*, coalesce(best.b || ' (' || CAST(CAST(trunc(best.r * 100) AS INTEGER) AS VARCHAR) || '% match)', '')
         AS correlated_with
  FROM bands LEFT JOIN best ON bands.issue_label = best.a
), tgt AS ({tgt.replace('bands', 'bc')}),
r AS (SELECT *, row_number() OVER (PARTITION BY issue_label ORDER BY month DESC) AS rd,
             count(*) OVER (PARTITION BY issue_label) AS nt FROM tgt),
f AS (SELECT l.*, f1.value AS v1, CAST(l.value AS DECIMAL(20,2)) AS dv, CAST(f1.value AS DECIMAL(20,2)) AS dv1 FROM r l JOIN r f1 ON l.issue_label = f1.issue_label AND f1.rd = 3
      WHERE l.rd = 1 AND l.nt >= 3),
fc AS (
  SELECT strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') || ' (Forecast)' AS month, issue_label,
    CAST(round(greatest(dv + (dv - dv1) * 0.5, 0), 2) AS DOUBLE) AS value,
    CAST(round(greatest(CAST(upper_bound AS DECIMAL(20,2)) + (dv - dv1) * 0.5, 0), 2) AS DOUBLE) AS upper_bound,
    coalesce(round((CAST(round(greatest(dv + (dv - dv1) * 0.5, 0), 2) AS DOUBLE) - value)
                   / (CASE WHEN value = 0 THEN 1.0 ELSE value END) * 100, 1), 0.0) AS mom_pct,
    correlated_with, true AS is_forecast
  FROM f
)
SELECT month, issue_label, value, upper_bound, mom_pct, correlated_with, false AS is_forecast FROM tgt
UNION ALL SELECT * FROM fc"""
    return "WITH " + ",\n".join(ctes) + body


def issue_correlation_sql(n: int, thr: float) -> str:
    ctes = trending_ctes(n) + [corr_best_cte("bands", "issue_label", "month", "value", thr)]
    return "WITH " + ",\n".join(ctes) + "\nSELECT a AS issue_label, b AS linked_to, round(r, 4) AS score FROM best"


def velocity_alerts_sql(n: int) -> str:
    ctes = base_ctes() + [month_window_cte(n), window_totals_cte("topic_id", "mentions")]
    pct = "round((c - p) / p * 100, 1)"
    body = f"""
, t AS (SELECT topic_id, CAST(coalesce(cur, 0) AS BIGINT) AS c, CAST(coalesce(prev, 0) AS BIGINT) AS p FROM wt),
v AS (SELECT *, {pct} AS velocity_pct FROM t WHERE p <> 0),
s AS (SELECT *, CASE WHEN velocity_pct >= 40 THEN 'CRITICAL' WHEN velocity_pct >= 20 THEN 'HIGH'
                     WHEN velocity_pct >= 10 THEN 'WATCH' END AS severity FROM v),
out AS (
  SELECT 'vel-' || substr(replace(lower(topic_id), ' ', '-'), 1, 20) AS id, topic_id AS category, velocity_pct,
    c AS curr_mentions, p AS prev_mentions, severity, 'Last {n}M' AS window,
    '🔴 ' || topic_id || ': ' || (CASE WHEN velocity_pct > 0 THEN '+' ELSE '' END)
      || CAST(CAST(velocity_pct AS DECIMAL(20,1)) AS VARCHAR) || '% mentions vs previous {n}M ('
      || CAST(p AS VARCHAR) || ' → ' || CAST(c AS VARCHAR) || ')' AS message
  FROM s WHERE severity IS NOT NULL
)
SELECT *, row_number() OVER (ORDER BY velocity_pct DESC, category) AS rank FROM out"""
    return "WITH " + ",\n".join(ctes) + body


def anomaly_cte(src: str, key: str, val: str, name: str = "an", k: float = 1.5, floor: float = 0.5,
                fill_null: bool = False) -> str:
    v = f"coalesce({val}, 0.0)" if fill_null else val
    thr = f"(CASE WHEN std_ > 0 THEN mean_ + {k} * std_ ELSE mean_ END)"
    return f"""{name}0 AS (
  SELECT {key}, month, CAST({v} AS DOUBLE) AS v,
    row_number() OVER (PARTITION BY {key} ORDER BY month DESC) AS rd,
    count(*) OVER (PARTITION BY {key}) AS np,
    avg(CAST({v} AS DOUBLE)) OVER (PARTITION BY {key} ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_,
    stddev_pop(CAST({v} AS DOUBLE)) OVER (PARTITION BY {key} ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS std_
  FROM {src}
),
{name} AS (
  SELECT {key}, v AS last, CASE WHEN np >= 3 THEN {thr} ELSE 0.0 END AS threshold,
    coalesce(np >= 3 AND v > {thr} AND v > {floor}, false) AS is_anomaly, np AS n_points
  FROM {name}0 WHERE rd = 1
)"""


def intelligence_alerts_sql(n: int, top: int = 6) -> str:
    m = "severity_weighted_rate"
    ctes = base_ctes() + fx_aspect_analysis_ctes() + [month_window_cte(n, "rest"), window_totals_cte("topic_id", m)]
    ctes += [f"""nm AS (SELECT count(DISTINCT month) AS n FROM fx_timeseries),
st AS (SELECT * FROM wt WHERE n_cur > 0),
top5 AS (SELECT topic_id FROM (SELECT topic_id, row_number() OVER (ORDER BY cur_max DESC, topic_id) AS r FROM st) x
         WHERE r <= 5),
g AS (SELECT topic_id, month, max({m}) AS v FROM fx_timeseries WHERE topic_id IN (SELECT topic_id FROM top5)
      GROUP BY 1, 2),
months5 AS (SELECT DISTINCT month FROM g),
gridf AS (SELECT t.topic_id, m.month, coalesce(g.v, 0.0) AS x FROM top5 t CROSS JOIN months5 m
          LEFT JOIN g ON g.topic_id = t.topic_id AND g.month = m.month)""",
             corr_best_cte("gridf", "topic_id", "month", "x", C.CORR_ALERTS, "lk"),
             anomaly_cte("fx_timeseries", "topic_id", m)]
    order = _order_case("aspect", list(C.ASPECT_KEYWORDS.keys()))
    body = f"""
, links AS (SELECT * FROM lk WHERE (SELECT n FROM nm) >= 3 AND (SELECT count(*) FROM top5) > 1),
a AS (
  SELECT st.topic_id, st.cur, coalesce(st.prev, 0.0) AS p, coalesce(an.is_anomaly, false) AS is_anomaly, an.threshold,
    links.b AS linked_to, round(links.r, 2) AS link_score,
    CASE WHEN coalesce(st.prev, 0.0) > 0 THEN round((st.cur - coalesce(st.prev, 0.0)) / coalesce(st.prev, 0.0) * 100, 1)
         ELSE 100.0 END AS vel
  FROM st LEFT JOIN an ON st.topic_id = an.topic_id LEFT JOIN links ON links.a = st.topic_id
  WHERE st.cur >= 5
),
t_out AS (
  SELECT 'int-' || substr(replace(lower(topic_id), ' ', '-'), 1, 15) AS id, topic_id AS category,
    CASE WHEN is_anomaly THEN 'ANOMALY' ELSE 'VELOCITY' END AS type,
    CASE WHEN is_anomaly AND vel > 40 THEN 'CRITICAL' WHEN is_anomaly OR vel > 25 THEN 'HIGH' ELSE 'WATCH' END AS severity,
    concat_ws(' | ', CASE WHEN is_anomaly THEN printf('Statistically out-of-control (Limit: %.1f)', threshold) END,
      CASE WHEN vel > 10 THEN 'MoM spike of +' || (CASE WHEN p > 0 THEN CAST(CAST(vel AS DECIMAL(20,1)) AS VARCHAR)
                                                     ELSE '100' END) || '%' END) AS message,
    CAST(vel AS DOUBLE) AS velocity_pct, is_anomaly, linked_to, link_score,
    1 AS _src, 0 AS _ord, topic_id AS _key
  FROM a WHERE is_anomaly OR vel > 10
),
a_out AS (
  SELECT 'asp-' || substr(lower(aspect), 1, 15) AS id, aspect AS category, 'ASPECT_DOMINANCE' AS type, 'HIGH' AS severity,
    printf('Dominant Volume: Accounting for %.1f%% of all feedback.', pct) AS message, 0.0 AS velocity_pct,
    false AS is_anomaly, CAST(NULL AS VARCHAR) AS linked_to, CAST(NULL AS DOUBLE) AS link_score,
    0 AS _src, {order} AS _ord, CAST(NULL AS VARCHAR) AS _key
  FROM (SELECT *, sum(mentions) OVER () AS tot_, mentions / sum(mentions) OVER () * 100 AS pct FROM fx_aspect_analysis) x
  WHERE tot_ > 0 AND pct >= {C.SHARE_ALERT_PCT}
),
u AS (SELECT * FROM a_out UNION ALL SELECT * FROM t_out),
rk AS (
  SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'WATCH' THEN 2
                                               ELSE 3 END, velocity_pct DESC, _src, _ord, _key) AS rank
  FROM u WHERE (SELECT n FROM nm) >= 2
)
SELECT id, category, type, severity, message, velocity_pct, is_anomaly, linked_to, link_score, rank
FROM rk WHERE rank <= {top}"""
    return "WITH " + ",\n".join(ctes) + body


def stability_scores_cte(round_to: int | None = 3) -> str:
    sc = "CAST(sum(CAST(t.mentions AS DECIMAL(20,0)) * CAST(coalesce(s.avg_severity, 2.0) AS DECIMAL(10,2))) AS DOUBLE) / sum(t.mentions)"
    if round_to is not None:
        sc = f"round({sc}, {round_to})"
    return f"""sc AS (
  SELECT t.month, {sc} AS score FROM fx_timeseries t LEFT JOIN fx_topics s ON t.issue_label = s.label
  GROUP BY t.month HAVING sum(t.mentions) > 0
),
sb AS (
  SELECT month, score, avg(score) OVER w AS rolling_mean, coalesce(stddev_samp(score) OVER w, 0.0) AS rolling_std
  FROM sc WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
),
sbands AS (
  SELECT month, score, rolling_mean, rolling_std, rolling_mean + 1.5 * rolling_std AS upper_band,
    rolling_mean - 1.5 * rolling_std AS lower_band,
    coalesce(score > rolling_mean + 1.5 * rolling_std OR score < rolling_mean - 1.5 * rolling_std, false) AS is_volatile
  FROM sb
)"""


def sentiment_stability_sql(n: int) -> str:
    cols = ("month, score, round(rolling_mean, 6) AS rolling_mean, round(rolling_std, 6) AS rolling_std, "
            "round(upper_band, 6) AS upper_band, round(lower_band, 6) AS lower_band, is_volatile")
    body = f"\nSELECT {cols} FROM sbands"
    if n > 0:
        body = f"\nSELECT {cols} FROM (" \
               f"SELECT *, row_number() OVER (ORDER BY month DESC) AS rd FROM sbands) x WHERE rd <= {n}"
    return "WITH " + ",\n".join(base_ctes() + [stability_scores_cte(3)]) + body


def _month_rank_cte(name: str = "mr") -> str:
    return f"""{name} AS (
  SELECT month, row_number() OVER (ORDER BY month DESC) AS rk, count(*) OVER () AS nm
  FROM (SELECT DISTINCT month FROM fx_timeseries WHERE month IS NOT NULL) d
)"""


def report_alerts_sql(n: int, top: int = 4) -> str:
    m = "severity_weighted_rate"
    if n > 0:
        fl = f"rk <= {n} AS is_cur, CASE WHEN nm >= {2*n} THEN rk > {n} AND rk <= {2*n} ELSE rk = 2 END AS is_prev"
    else:
        fl = "rk = 1 AS is_cur, rk = 2 AS is_prev"
    ctes = base_ctes() + [_month_rank_cte(), f"fl AS (SELECT month, {fl}, nm FROM mr)",
                          anomaly_cte("fx_timeseries", "issue_label", m, fill_null=True)]
    r = "CAST(CAST(round_even(velocity_pct, 0) AS BIGINT) AS VARCHAR)"
    body = f"""
, t AS (
  SELECT issue_label, CAST(sum(CASE WHEN is_cur THEN mentions END) AS DOUBLE) AS c,
         CAST(coalesce(sum(CASE WHEN is_prev THEN mentions END), 0) AS DOUBLE) AS p, max(nm) AS nm
  FROM fx_timeseries JOIN fl USING (month) GROUP BY issue_label
), a AS (
  SELECT t.*, coalesce(an.is_anomaly, false) AS is_anomaly,
    CASE WHEN p = 0 THEN 100.0 ELSE round((c - p) / p * 100, 1) END AS velocity_pct
  FROM t LEFT JOIN an USING (issue_label) WHERE c > 0
), b AS (
  SELECT issue_label AS category,
    CASE WHEN is_anomaly AND velocity_pct > 40 THEN 'CRITICAL' WHEN is_anomaly OR velocity_pct > 25 THEN 'HIGH'
         ELSE 'WATCH' END AS severity,
    CASE WHEN is_anomaly AND velocity_pct > 10 THEN 'Statistically out-of-control with a +' || {r} || '% MoM spike.'
         WHEN is_anomaly THEN 'Statistically out-of-control versus baseline.'
         ELSE 'Mentions increased by about ' || {r} || '% compared with the previous window.' END AS message,
    velocity_pct
  FROM a WHERE (is_anomaly OR velocity_pct > 10) AND nm >= 2
), r AS (
  SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'WATCH' THEN 2
                                         ELSE 3 END, velocity_pct DESC, category) AS rank FROM b
)
SELECT * FROM r WHERE rank <= {top}"""
    return "WITH " + ",\n".join(ctes) + body


def report_aspects_sql(n: int, top: int = 4) -> str:
    cur = f"rk <= {n}" if n > 0 else "rk = 1"
    prev = f"rk > {n} AND rk <= {2*n} AND nm >= {2*n}" if n > 0 else "false"
    ctes = base_ctes() + fx_aspect_analysis_ctes() + [_month_rank_cte(), _aspect_map_values(),
                                                       f"fl AS (SELECT month, {cur} AS is_cur, {prev} AS is_prev FROM mr)"]
    body = f"""
, totals AS (
  SELECT aspect, mentions, share, row_number() OVER (ORDER BY mentions DESC, aspect) AS rank FROM (
    SELECT aspect, sum(mentions) AS mentions, sum(mentions) / greatest(sum(sum(mentions)) OVER (), 1) * 100 AS share
    FROM fx_aspect_analysis GROUP BY aspect) x
), vols AS (
  SELECT a.aspect, sum(CASE WHEN is_cur THEN mentions END) AS cv, sum(CASE WHEN is_prev THEN mentions END) AS pv
  FROM fx_timeseries t JOIN fl USING (month) JOIN amap a ON a.issue_label = t.issue_label GROUP BY a.aspect
), j AS (
  SELECT t.*, CASE WHEN coalesce(pv, 0) > 0 THEN round((coalesce(cv, 0) - coalesce(pv, 0)) / coalesce(pv, 0) * 100, 1)
                   ELSE 0.0 END AS momentum
  FROM totals t LEFT JOIN vols v USING (aspect) WHERE rank <= {top}
)
SELECT aspect, CAST(mentions AS BIGINT) AS mentions, momentum,
  CASE WHEN share >= 25 OR momentum >= 20 THEN 'Critical' WHEN share >= 14 OR momentum > 0 THEN 'Active'
       ELSE 'Watch' END AS priority, rank
FROM j"""
    return "WITH " + ",\n".join(ctes) + body


def report_stability_sql() -> str:
    ctes = base_ctes() + [stability_scores_cte(None)]
    return "WITH " + ",\n".join(ctes) + """
SELECT round(arg_max(score, month), 2) AS baseline, CAST(count(*) FILTER (WHERE is_volatile) AS BIGINT) AS volatility_count,
  CASE WHEN arg_max(is_volatile, month) THEN 'High volatility detected' ELSE 'Stable emotional range' END AS status,
  max(month) AS latest_month, list_sort(coalesce(list(month) FILTER (WHERE is_volatile), [])) AS volatile_months
FROM sbands"""


def report_movers_sql(n: int, top: int = 4, min_mentions: int = 15) -> str:
    m = "severity_weighted_rate"
    first = f"CASE WHEN nm >= {n} THEN rk = {n} ELSE rk = nm END" if n > 0 else "rk = nm"
    ctes = base_ctes() + [_month_rank_cte(), f"fl AS (SELECT month, {first} AS is_first, rk = 1 AS is_last, nm FROM mr)"]
    body = f"""
, t AS (
  SELECT issue_label, sum(mentions) AS tot,
    CAST(coalesce(max(CASE WHEN is_first THEN {m} END), 0.0) AS DOUBLE) AS s,
    CAST(coalesce(max(CASE WHEN is_last THEN {m} END), 0.0) AS DOUBLE) AS e, max(nm) AS nm
  FROM fx_timeseries JOIN fl USING (month) GROUP BY issue_label
), c AS (
  SELECT issue_label AS label, CASE WHEN s = 0 THEN 100.0 ELSE round((e - s) / s * 100, 1) END AS change_pct
  FROM t WHERE tot >= {min_mentions} AND NOT (s = 0 AND e = 0) AND nm >= 2
), r AS (
  SELECT label, change_pct, CASE WHEN change_pct > 0 THEN 'Rising' ELSE 'Cooling' END AS direction,
         row_number() OVER (ORDER BY abs(change_pct) DESC, label) AS rank FROM c
)
SELECT * FROM r WHERE rank <= {top}"""
    return "WITH " + ",\n".join(ctes) + body


def report_sentiment_sql(n: int) -> str:
    return "WITH " + ",\n".join([fx_reviews_cte(), review_stats_cte(n)]) + """
, x AS (
  SELECT *, pos_cur + neg_cur AS tc, pos_prev + neg_prev AS tp FROM rs
), y AS (
  SELECT *, CASE WHEN tc > 0 THEN round(pos_cur / tc * 100, 1) ELSE 0.0 END AS pc,
            CASE WHEN tc > 0 THEN round(neg_cur / tc * 100, 1) ELSE 0.0 END AS nc,
            CASE WHEN tp > 0 THEN round(pos_prev / tp * 100, 1) ELSE 0.0 END AS pp FROM x
)
SELECT CAST(pos_cur AS BIGINT) AS positive, CAST(neg_cur AS BIGINT) AS negative, pc AS positive_pct, nc AS negative_pct,
  CASE WHEN n_prev > 0 THEN round(pc - pp, 1) ELSE 0.0 END AS momentum
FROM y WHERE n_cur > 0"""


def report_kpis_sql(n: int) -> str:
    ctes = base_ctes() + [fx_reviews_cte(), review_stats_cte(n), month_window_cte(n),
                          window_totals_cte("issue_label", "mentions")]
    win = f"Last {n} Months" if n > 0 else "All Time"
    body = f"""
, act AS (
  SELECT count(*) FILTER (WHERE cur > 0) AS active_cur,
         CASE WHEN count(*) FILTER (WHERE n_prev > 0) > 0 THEN count(*) FILTER (WHERE prev > 0) END AS active_prev
  FROM wt
), k AS (
  SELECT rs.*, round(avg_cur, 2) AS avg_c, round(avg_prev, 2) AS avg_p,
    CASE WHEN n_cur > 0 THEN round(pos_cur / n_cur * 100, 1) ELSE 0.0 END AS pp_c,
    CASE WHEN n_prev > 0 THEN round(pos_prev / n_prev * 100, 1) ELSE 0.0 END AS pp_p,
    act.active_cur, act.active_prev
  FROM rs, act
)
SELECT 1 AS card, 'Total Feedback' AS label, format('{{:,}}', n_cur) AS value, '{win}' AS sub,
  CAST(CASE WHEN n_prev > 0 THEN round((n_cur - n_prev) / n_prev * 100, 1) END AS DOUBLE) AS delta, '%' AS delta_suffix FROM k
UNION ALL
SELECT 2, 'Avg Rating', CASE WHEN avg_c IS NOT NULL THEN CAST(avg_c AS VARCHAR) || '/5.0' ELSE 'N/A' END, 'Average score',
  CAST(CASE WHEN n_prev > 0 AND avg_c IS NOT NULL AND avg_p IS NOT NULL THEN round(avg_c - avg_p, 1) END AS DOUBLE), '' FROM k
UNION ALL
SELECT 3, 'Customer Happiness', CAST(pp_c AS VARCHAR) || '%', 'Positive sentiment share',
  CAST(CASE WHEN n_prev > 0 THEN round(pp_c - pp_p, 1) END AS DOUBLE), ' pts' FROM k
UNION ALL
SELECT 4, 'Total Issues Found', CAST(active_cur AS VARCHAR), 'Distinct active issue clusters',
  CAST(CASE WHEN active_prev IS NOT NULL THEN active_cur - active_prev END AS DOUBLE), '' FROM k"""
    return "WITH " + ",\n".join(ctes) + body


def report_top_issues_sql(n: int, top: int = 10) -> str:
    ctes = base_ctes()
    if n > 0:
        ctes = ctes + [month_window_cte(n)]
        src = """SELECT t.label, coalesce(w.wm, 0) AS mentions, t.avg_severity, t.sample_reviews FROM fx_topics t LEFT JOIN (
    SELECT issue_label, sum(mentions) AS wm FROM fx_timeseries JOIN mw USING (month) WHERE period = 'cur'
    GROUP BY 1) w ON w.issue_label = t.label"""
    else:
        src = "SELECT label, mentions, avg_severity, sample_reviews FROM fx_topics"
    body = f"""
, t AS ({src}),
e AS (
  SELECT label, CAST(mentions AS BIGINT) AS mentions, round(avg_severity, 1) AS severity,
    coalesce(list_filter(list_transform(sample_reviews, lambda x: regexp_replace(x, '^[ ''"\n\t]+|[ ''"\n\t]+$', '', 'g')),
                         lambda x: x <> '')[1], 'No evidence snippet available.') AS evidence, avg_severity
  FROM t WHERE mentions > 0
), r AS (
  SELECT label, mentions, severity, evidence,
    row_number() OVER (ORDER BY mentions DESC, avg_severity DESC, label) AS rank FROM e
)
SELECT * FROM r WHERE rank <= {top}"""
    return "WITH " + ",\n".join(ctes) + body


def _fx():
    from vocspark.sources import fixtures as FX
    return FX


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: x <> '')"


def text_scores_sql() -> str:
    FX = _fx()
    ws = f"list_distinct({_words_sql('text')})"
    sev = f"""least(round(2.0
      + (CASE WHEN len(list_intersect(ws, {_sql_list(FX.FX_SEVERITY_5)})) > 0 THEN 2.5
              WHEN len(list_intersect(ws, {_sql_list(FX.FX_SEVERITY_4)})) > 0 THEN 1.5
              WHEN len(list_intersect(ws, {_sql_list(FX.FX_SEVERITY_3)})) > 0 THEN 0.5 ELSE 0.0 END)
      + (CASE WHEN length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(text), 1) > 0.3 THEN 0.5 ELSE 0.0 END)
      + least((length(text) - length(replace(text, '!', ''))) * 0.2, 0.6), 2), 5.0)"""
    act = f"""CASE WHEN len(ws) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, round(
        least(len(list_intersect(ws, {_sql_list(FX.FX_SIGNAL)})) * 0.3, 0.9)
        + (CASE WHEN length(text) > 50 AND length(text) < 300 THEN 0.1 ELSE 0.0 END)
        - least(len(list_intersect(ws, {_sql_list(FX.FX_VENT)})) * 0.1, 0.4), 2))) END"""
    return f"""SELECT doc_id, CAST({sev} AS DOUBLE) AS severity, CAST({act} AS DOUBLE) AS actionability
FROM (SELECT doc_id, text, {ws} AS ws FROM documents) d"""


def valid_reviews_sql() -> str:
    return "WITH " + ",\n".join([docs_valid_cte(), docs_valid_cte(lang=None, name="docs_any")]) + """
SELECT v.doc_id, v.is_valid, a.is_valid AS is_valid_any_lang FROM docs_valid v JOIN docs_any a ON v.doc_id = a.doc_id"""


def clean_text_sql() -> str:
    from vocspark.functions.text import STOP_WORDS
    t = "regexp_replace(regexp_replace(lower(coalesce(text, '')), 'http\\S+|www\\S+', '', 'g'), '[^a-zA-Z\\s]', '', 'g')"
    lem = ("CASE WHEN length(w) > 4 AND suffix(w, 'ies') THEN regexp_replace(w, 'ies$', 'y') "
           "WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') AND NOT suffix(w, 'us') AND NOT suffix(w, 'is') "
           "THEN regexp_replace(w, 's$', '') ELSE w END")
    return f"""SELECT doc_id, array_to_string(list_transform(
    list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '' AND NOT list_contains({_sql_list(STOP_WORDS)}, w)),
    lambda w: {lem}), ' ') AS cleaned_content
FROM documents"""


def value_weight_sql() -> str:
    w = f"round({_tier_weight_case('user_tier')} * (CASE WHEN TRY_CAST(clv AS DOUBLE) > 0 THEN 1.0 + ln(1.0 + TRY_CAST(clv AS DOUBLE) / 100.0) ELSE 1.0 END), 2)"
    return "WITH " + fx_reviews_cte() + f"\nSELECT reviewId, CAST({w} AS DOUBLE) AS value_weight FROM fx_reviews"


def _hash_bucket_sql(key: str) -> str:
    h = f"md5(CAST({key} AS VARCHAR))"
    acc = "0"
    for i in range(4):
        chunk = f"CAST('0x' || substr({h}, {8*i+1}, 8) AS BIGINT)"
        acc = f"(({acc}) * 96 + {chunk}) % 100"
    return acc


def hash_tier_sql() -> str:
    b = _hash_bucket_sql("doc_id")
    cases = " ".join(f"WHEN bucket < {u} THEN {w}" for u, w in C.HASH_TIER_BUCKETS[:-1])
    return f"""SELECT doc_id, bucket, CAST(CASE {cases} ELSE {C.HASH_TIER_BUCKETS[-1][1]} END AS DOUBLE) AS value_weight
FROM (SELECT doc_id, CAST({b} AS BIGINT) AS bucket FROM documents) d"""


def cluster_keywords_cte(k: int = 5) -> str:
    return f"""ck_wc AS (
  SELECT doc_id, word, count(*) AS cnt FROM (SELECT doc_id, unnest({_words_sql('text')}) AS word FROM documents) u
  GROUP BY 1, 2
), ck_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, word) AS rk FROM ck_wc) x
  WHERE rk <= {k} AND NOT list_contains({_sql_list(C.CLUSTER_STOP_WORDS)}, word) AND length(word) >= 4
), ck AS (
  SELECT d.doc_id, coalesce(g.kw, '') AS keywords FROM (SELECT DISTINCT doc_id FROM documents) d
  LEFT JOIN (SELECT doc_id, string_agg(word, ', ' ORDER BY rk) AS kw FROM ck_top GROUP BY 1) g ON d.doc_id = g.doc_id
)"""


def cluster_keywords_sql() -> str:
    return "WITH " + cluster_keywords_cte() + "\nSELECT doc_id, keywords FROM ck"


def keyword_titles_sql() -> str:
    def cap(w):
        return f"(upper(substr({w}, 1, 1)) || lower(substr({w}, 2)))"
    stop = _sql_list(C.TITLE_STOP_WORDS)
    return "WITH " + cluster_keywords_cte() + f"""
, kt AS (
  SELECT doc_id, keywords, list_transform(string_split(keywords, ','), lambda w: trim(w)) AS ow,
         list_transform(string_split(keywords, ','), lambda w: lower(trim(w))) AS ws FROM ck
), kt2 AS (SELECT *, list_filter(ws, lambda w: NOT list_contains({stop}, w)) AS kept FROM kt)
SELECT doc_id, keywords,
  CASE WHEN len(ow) >= 2 THEN {cap('ow[1]')} || ' ' || {cap('ow[2]')} || ' Issues' ELSE {cap('ow[1]')} || ' Issues' END AS old_label,
  CASE WHEN keywords IS NULL OR trim(keywords) = '' THEN 'General Issue'
       WHEN len(kept) >= 2 THEN {cap('kept[1]')} || ' ' || {cap('kept[2]')} || ' Task'
       WHEN len(kept) = 1 THEN {cap('kept[1]')} || ' Related Problems'
       ELSE {cap('ws[1]')} || ' System Feedback' END AS new_label
FROM kt2"""


def _norm_sql(v: str, eps: str | None = None) -> str:
    n = f"sqrt(list_sum(list_transform({v}, lambda y: y * y)))"
    d = f"({n} + {eps})" if eps else f"(CASE WHEN {n} = 0 THEN 1.0 ELSE {n} END)"
    return f"list_transform({v}, lambda x: x / {d})"


def fx_vectors_cte() -> str:
    return """fx_vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding, 'c' || CAST(label AS VARCHAR) AS category,
         '2024-0' || CAST(1 + vec_id % 6 AS VARCHAR) AS month
  FROM embeddings
)"""


def centroids_cte(src: str, key: str, vec: str, name: str = "cents", eps: str | None = None) -> str:
    return f"""{name}_m AS (
  SELECT {key}, i, avg(x) AS m, count(*) AS n FROM (
    SELECT {key}, generate_subscripts({vec}, 1) AS i, unnest({vec}) AS x FROM {src}) u GROUP BY 1, 2
),
{name} AS (
  SELECT {key}, {_norm_sql('v', eps)} AS centroid, n FROM (
    SELECT {key}, list(m ORDER BY i) AS v, max(n) AS n FROM {name}_m GROUP BY 1) g
)"""


def executive_summary_sql(n: int) -> str:
    """Signals and markdown of the top issue; every signal is a one-row CTE."""
    ts = ("SELECT t.* FROM fx_timeseries t JOIN mw USING (month) WHERE mw.period = 'cur'" if n > 0
          else "SELECT * FROM fx_timeseries")
    if n > 0:
        cur, prev = f"rk <= {n}", f"rk > {n} AND rk <= {2 * n} AND nm >= {2 * n}"
    else:
        cur, prev = "rk = 1", "false"
    spike = "last_v > (CASE WHEN std_prev > 0 THEN mean_prev + 1.5 * std_prev ELSE mean_prev END) AND last_v > 0.5"
    pct = "CASE WHEN n_pts >= 2 AND prev_v > 0 AND last_v <> prev_v THEN CAST(trunc(abs(last_v - prev_v) / prev_v * 100) AS INTEGER) END"
    return "WITH " + ",\n".join(base_ctes() + [month_window_cte(n), _aspect_map_values()]) + f"""
, e_ts AS (SELECT issue_label, month, mentions, severity_weighted_rate AS v FROM ({ts}) q WHERE issue_label <> '{C.FALLBACK_LABEL}'),
e_tp AS (SELECT * FROM fx_topics WHERE label <> '{C.FALLBACK_LABEL}'),
e_x AS (
  SELECT *, min(month) OVER () AS m_first, max(month) OVER () AS m_last,
    row_number() OVER (PARTITION BY issue_label ORDER BY month DESC) AS rd,
    avg(v) OVER (PARTITION BY issue_label ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_prev,
    stddev_pop(v) OVER (PARTITION BY issue_label ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS std_prev,
    lag(v) OVER (PARTITION BY issue_label ORDER BY month) AS prev_v,
    row_number() OVER (PARTITION BY issue_label ORDER BY month) AS xn
  FROM e_ts),
e_slope AS (
  SELECT issue_label, regr_slope(v, xn) AS slope, count(*) AS n3 FROM e_x WHERE rd <= 3 GROUP BY 1),
e_lab AS (
  SELECT x.issue_label AS label, sum(mentions) AS vol, max(v) AS peak, count(*) AS n_pts,
    max(CASE WHEN rd = 1 THEN v END) AS last_v, max(CASE WHEN rd = 1 THEN mean_prev END) AS mean_prev,
    max(CASE WHEN rd = 1 THEN std_prev END) AS std_prev, max(CASE WHEN rd = 1 THEN prev_v END) AS prev_v,
    coalesce(max(CASE WHEN month = m_last THEN v END), 0.0) AS c_end,
    coalesce(max(CASE WHEN month = m_first THEN v END), 0.0) AS c_start,
    max(m_first) AS m_first, max(m_last) AS m_last
  FROM e_x x GROUP BY 1),
e_r0 AS (SELECT tp.label, tp.avg_severity, tp.mentions, tp.sample_reviews, l.* EXCLUDE (label),
           count(*) FILTER (WHERE l.vol >= 15) OVER () AS n_valid
         FROM e_tp tp LEFT JOIN e_lab l ON l.label = tp.label),
e_r1 AS (SELECT *, CASE WHEN n_valid > 0 THEN coalesce(CASE WHEN vol >= 15 THEN peak END, 0.0) ELSE CAST(mentions AS DOUBLE) END AS sort_score
         FROM e_r0),
e_r AS (SELECT *, row_number() OVER (ORDER BY sort_score DESC, label) AS rk FROM e_r1),
e_top AS (SELECT r.*, CASE WHEN s.n3 >= 3 THEN s.slope END AS slope FROM e_r r LEFT JOIN e_slope s ON s.issue_label = r.label WHERE rk = 1),
e_g AS (SELECT t.issue_label, t.month, max(v) AS v FROM e_ts t JOIN e_r r ON r.label = t.issue_label AND r.rk <= 5 GROUP BY 1, 2),
e_full AS (
  SELECT l.issue_label, m.month, coalesce(g.v, 0.0) AS v
  FROM (SELECT DISTINCT issue_label FROM e_g) l CROSS JOIN (SELECT DISTINCT month FROM e_g) m
  LEFT JOIN e_g g ON g.issue_label = l.issue_label AND g.month = m.month),
e_pairs AS (
  SELECT b.issue_label AS linked, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS c
  FROM e_full a JOIN e_top t ON a.issue_label = t.label JOIN e_full b ON a.month = b.month AND a.issue_label <> b.issue_label GROUP BY 1),
e_link AS (SELECT linked FROM (SELECT *, row_number() OVER (ORDER BY c DESC, linked) AS o FROM e_pairs WHERE c IS NOT NULL AND NOT isnan(c)) q
           WHERE o = 1 AND c > {C.CORR_TRENDING}),
e_mv AS (SELECT label, (c_end - c_start) / c_start * 100 AS chg FROM e_lab WHERE vol >= 15 AND c_start > 0 AND abs(c_end - c_start) >= 0.5),
e_months AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS rk, count(*) OVER () AS nm FROM (SELECT DISTINCT month FROM e_ts) d),
e_av AS (
  SELECT a.aspect, sum(CASE WHEN {cur} THEN t.mentions END) AS cv, coalesce(sum(CASE WHEN {prev} THEN t.mentions END), 0) AS pv
  FROM e_ts t JOIN e_months m ON m.month = t.month JOIN amap a ON a.issue_label = t.issue_label
  WHERE a.aspect <> '{C.GENERAL_ASPECT}' GROUP BY 1),
e_mom AS (SELECT aspect, CASE WHEN pv > 0 THEN round((cv - pv) / pv * 100, 1) ELSE 0.0 END AS mom FROM e_av WHERE cv > 0),
e_asp AS (SELECT list_sort(list(aspect || ': **' || CASE WHEN mom > 15 THEN 'Getting Worse' WHEN mom < -15 THEN 'Improving' ELSE 'Stable' END || '**')) AS lines
          FROM e_mom),
e_sc AS (
  SELECT t.month, CAST(sum(CAST(t.mentions AS DECIMAL(20,0)) * CAST(coalesce(p.avg_severity, 2.0) AS DECIMAL(10,2))) AS DOUBLE) / sum(t.mentions) AS score
  FROM e_ts t LEFT JOIN e_tp p ON p.label = t.issue_label GROUP BY 1 HAVING sum(t.mentions) > 0),
e_vol AS (
  SELECT coalesce(n >= 3 AND (score > m + 1.5 * s OR score < m - 1.5 * s), false) AS volatile FROM (
    SELECT *, avg(score) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
      stddev_pop(score) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s,
      count(*) OVER () AS n, row_number() OVER (ORDER BY month DESC) AS rd FROM e_sc) q WHERE rd = 1),
e_j AS (
  SELECT t.*, (SELECT count(*) FROM e_months) AS n_months,
    CASE WHEN (SELECT count(*) FROM e_months) >= 3 THEN (SELECT linked FROM e_link) END AS linked_issue,
    (SELECT label FROM e_mv WHERE chg > 0 ORDER BY chg DESC, label LIMIT 1) AS biggest_riser,
    (SELECT label FROM e_mv WHERE chg < 0 ORDER BY chg, label LIMIT 1) AS biggest_faller,
    coalesce((SELECT lines FROM e_asp), []) AS aspect_status, coalesce((SELECT volatile FROM e_vol), false) AS volatility_alert,
    CASE WHEN n_pts IS NULL OR n_pts < 3 THEN 'Steady' WHEN {spike} THEN 'Significant Spike' WHEN last_v > mean_prev THEN 'Rising' ELSE 'Steady' END AS state,
    CASE WHEN slope > 0.2 THEN 'worsening' WHEN slope < -0.2 THEN 'improving' ELSE 'flat' END AS outlook,
    {pct} AS trend_pct,
    CASE WHEN n_pts >= 2 AND prev_v > 0 THEN (CASE WHEN last_v > prev_v THEN 'spiking' WHEN last_v < prev_v THEN 'decreasing' END) END AS trend_direction,
    coalesce(sample_reviews[1], 'No clear textual evidence.') AS evidence
  FROM e_top t),
e_k AS (
  SELECT *, CASE WHEN sort_score > 800 THEN 'high impact' WHEN sort_score > 400 THEN 'notable impact' ELSE 'minor impact' END AS impact,
    CASE WHEN avg_severity > 4.0 THEN 'Urgent: Assign a team to fix this quickly to avoid losing money.'
         WHEN coalesce(trend_pct, 0) > 25 THEN 'Action: Check recent app updates to see what caused this sudden spike.'
         WHEN label = 'App Crash & Launch Failure' THEN 'Action: Check technical logs and consider rolling back the last update.'
         ELSE 'Standard: Keep an eye on this trend and plan a fix in the next roadmap.' END AS next_best_action
  FROM e_j)
SELECT label AS top_issue, state, CAST(sort_score AS DOUBLE) AS sort_score, CAST(avg_severity AS DOUBLE) AS avg_severity, linked_issue, outlook,
  trend_direction, trend_pct, biggest_riser, biggest_faller, volatility_alert, aspect_status, next_best_action, impact,
  'Analysis Period: ' || m_first || ' — ' || m_last || ' (' || CAST(n_months AS VARCHAR) || ' months total)' AS period, evidence,
  '### Primary Focus: ' || label || chr(10) || '**Current Situation:** This topic is currently **' || lower(state) || '** and is having a **'
    || impact || '** on your customers. '
    || concat_ws(' ', 'Highly linked to **' || linked_issue || '**, suggesting they might have the same root cause.',
         CASE outlook WHEN 'worsening' THEN 'This is expected to get worse soon. We should look into it.'
                      WHEN 'improving' THEN 'This is expected to improve soon.' END)
    || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '### Suggested Action' || chr(10) || '**' || next_best_action || '**' || chr(10) || chr(10)
    || '---' || chr(10) || chr(10) || '### General App Health' || chr(10) || '**Status:** '
    || CASE WHEN volatility_alert THEN 'HIGH EMOTIONAL VOLATILITY DETECTED.'
            ELSE 'Monitoring is active. All systems are currently within normal performance ranges.' END
    || CASE WHEN len(aspect_status) > 0 THEN chr(10) || chr(10) || '**Category Performance:**' || chr(10)
            || array_to_string(list_transform(aspect_status, lambda s: '- ' || s), chr(10)) ELSE '' END
    || CASE WHEN biggest_riser IS NOT NULL AND biggest_riser <> label
            THEN chr(10) || chr(10) || '**Watch Out:** ' || biggest_riser || ' is starting to trend upward.' ELSE '' END
    || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '### What Customers are Saying' || chr(10) || '> *"' || substr(evidence, 1, 200) || '..."*' AS summary
FROM e_k"""


def near_dup_evidence_sql(keep: int = 15, threshold: float = 0.85, candidates: int = 20) -> str:
    """The greedy walk as a recursion over ranks: each step looks at one candidate of every group."""
    return "WITH RECURSIVE " + ",\n".join([fx_vectors_cte(), centroids_cte("fx_vectors", "category", "embedding")]) + f"""
, ranked AS (
  SELECT v.category, v.vec_id, {_norm_sql('v.embedding')} AS u,
         row_number() OVER (PARTITION BY v.category ORDER BY list_dot_product({_norm_sql('v.embedding')}, c.centroid) DESC, v.vec_id) AS rk
  FROM fx_vectors v JOIN cents c ON v.category = c.category
),
walk AS (
  SELECT category, 0::BIGINT AS rk, []::VARCHAR[] AS kept, []::DOUBLE[][] AS us FROM (SELECT DISTINCT category FROM ranked) g
  UNION ALL
  SELECT w.category, r.rk,
    CASE WHEN len(w.kept) < {keep} AND NOT coalesce(list_bool_or(list_transform(w.us, lambda k: list_dot_product(k, r.u) >= {threshold})), false)
         THEN list_append(w.kept, CAST(r.vec_id AS VARCHAR)) ELSE w.kept END,
    CASE WHEN len(w.kept) < {keep} AND NOT coalesce(list_bool_or(list_transform(w.us, lambda k: list_dot_product(k, r.u) >= {threshold})), false)
         THEN list_append(w.us, r.u) ELSE w.us END
  FROM walk w JOIN ranked r ON r.category = w.category AND r.rk = w.rk + 1
  WHERE r.rk <= {candidates}
)
SELECT category, kept FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rk DESC) AS o FROM walk) x WHERE o = 1"""


def category_centroids_sql() -> str:
    return "WITH " + ",\n".join([fx_vectors_cte(), centroids_cte("fx_vectors", "category", "embedding")]) + \
        "\nSELECT category, list_transform(centroid, lambda x: round(x, 6)) AS centroid, CAST(n AS BIGINT) AS n FROM cents"


def semantic_classify_sql() -> str:
    return "WITH " + ",\n".join([fx_vectors_cte(), centroids_cte("fx_vectors", "category", "embedding")]) + f"""
, vn AS (SELECT vec_id, category, {_norm_sql('embedding')} AS u FROM fx_vectors),
sims AS (SELECT v.vec_id, v.category, c.category AS cc, list_dot_product(v.u, c.centroid) AS s FROM vn v CROSS JOIN cents c),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cc) AS r FROM sims) x WHERE r = 1)
SELECT vec_id, category, cc AS best_label, round(s, 4) AS confidence,
       CASE WHEN s >= 0.3 THEN cc ELSE 'General App Feedback' END AS predicted
FROM best"""


def semantic_search_sql(top: int = 15) -> str:
    return "WITH " + fx_vectors_cte() + f"""
, q AS (SELECT {_norm_sql('embedding')} AS qv FROM fx_vectors WHERE vec_id = 0),
s AS (SELECT vec_id, list_dot_product({_norm_sql('embedding')}, (SELECT qv FROM q)) AS score FROM fx_vectors),
r AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {top}"""


def _silhouette_body(u: str) -> str:
    return f"""
, u AS ({u}),
p AS (SELECT a.id, a.l AS la, b.l AS lb, 1 - list_dot_product(a.u, b.u) AS d FROM u a JOIN u b ON a.id <> b.id),
m AS (SELECT id, la, lb, avg(d) AS md FROM p GROUP BY 1, 2, 3),
s AS (SELECT id, la, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM m GROUP BY 1, 2),
sz AS (SELECT l, count(*) AS n FROM u GROUP BY 1),
per AS (SELECT CASE WHEN sz.n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS sv
        FROM u LEFT JOIN s ON u.id = s.id LEFT JOIN sz ON sz.l = u.l)
SELECT 'silhouette_score' AS metric, round(avg(sv), 4) AS value, CAST((SELECT count(*) FROM sz) AS INTEGER) AS n_categories,
  CAST(count(*) AS INTEGER) AS n_samples, CAST({C.CONFIDENCE_THRESHOLD} AS DOUBLE) AS threshold_confidence,
  CAST({C.DEDUP_THRESHOLD} AS DOUBLE) AS dedup_threshold
FROM per HAVING (SELECT count(*) FROM sz) >= 2"""


def silhouette_sql() -> str:
    """Brute-force pairwise definition (the Spark operator uses cluster sums)."""
    return "WITH " + fx_vectors_cte() + _silhouette_body(
        f"SELECT vec_id AS id, category AS l, {_norm_sql('embedding')} AS u FROM fx_vectors")


def fx_semantic_cte() -> str:
    return """fx_semantic AS (
  SELECT d.doc_id, d.text, d.lang, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS embedding,
         'c' || CAST(e.label AS VARCHAR) AS category, '2024-0' || CAST(1 + d.doc_id % 6 AS VARCHAR) AS month
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)
)"""


def shifting_terms_cte(src: str = "fx_semantic") -> str:
    return f"""st_wc AS (
  SELECT category, month, word, count(*) AS cnt FROM (
    SELECT category, month, unnest({_words_sql('text')}) AS word FROM {src}) u GROUP BY 1, 2, 3
), st_pairs AS (
  SELECT category, lag(month) OVER (PARTITION BY category ORDER BY month) AS mf, month AS mt
  FROM (SELECT DISTINCT category, month FROM {src}) m
), st_j AS (
  SELECT p.category, p.mf, p.mt, c.word, c.cnt - coalesce(pv.cnt, 0) AS score
  FROM st_pairs p JOIN st_wc c ON c.category = p.category AND c.month = p.mt AND length(c.word) >= 4
  LEFT JOIN st_wc pv ON pv.category = p.category AND pv.month = p.mf AND pv.word = c.word
  WHERE p.mf IS NOT NULL
), st_t AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, mf, mt ORDER BY score DESC, word) AS rk
                 FROM st_j WHERE score > 0) x WHERE rk <= 3
), st AS (
  SELECT category, mf AS month_from, mt AS month_to, string_agg(word, ', ' ORDER BY rk) AS shifting_terms
  FROM st_t GROUP BY 1, 2, 3
)"""


def shifting_terms_sql() -> str:
    return "WITH " + ",\n".join([fx_semantic_cte(), shifting_terms_cte()]) + "\nSELECT * FROM st"


def drift_ctes(source: list[str] | None = None, name: str = "fx_semantic") -> list[str]:
    """drift over a source with category, month, text and embedding."""
    return [*(source or [fx_semantic_cte()]),
            f"fs_k AS (SELECT category || '|' || month AS k, category, month, embedding FROM {name})",
            centroids_cte("fs_k", "k", "embedding", "dc", eps="1e-8"),
            shifting_terms_cte(name),
            """dcm AS (SELECT split_part(k, '|', 1) AS category, split_part(k, '|', 2) AS month, centroid FROM dc),
dp AS (
  SELECT category, lag(month) OVER w AS month_from, month AS month_to, lag(centroid) OVER w AS pc, centroid
  FROM dcm WINDOW w AS (PARTITION BY category ORDER BY month)
),
drift AS (
  SELECT dp.category, dp.month_from, dp.month_to, round(1.0 - list_dot_product(pc, centroid), 4) AS drift_score,
    round(1.0 - list_dot_product(pc, centroid), 4) > 0.12 AS is_evolving, coalesce(st.shifting_terms, '') AS shifting_terms
  FROM dp LEFT JOIN st ON st.category = dp.category AND st.month_from = dp.month_from AND st.month_to = dp.month_to
  WHERE dp.month_from IS NOT NULL
)"""]


def semantic_drift_sql() -> str:
    return "WITH " + ",\n".join(drift_ctes()) + "\nSELECT * FROM drift"


def semantic_drift_summary_sql(cut: float = 0.0) -> str:
    return "WITH " + ",\n".join(drift_ctes()) + f"""
, g AS (
  SELECT category, avg(drift_score) AS a, max(drift_score) AS mx, count(*) AS n,
         round(avg(CAST(round(drift_score * 10000) AS BIGINT)), 0) / 10000.0 AS a4,
         arg_max(shifting_terms, month_from || '|' || month_to) AS terms
  FROM drift GROUP BY category HAVING avg(drift_score) > {cut}
)
SELECT category, a4 AS avg_drift, round(mx, 4) AS max_drift, CAST(n AS BIGINT) AS n_months,
  coalesce(terms, 'stable') AS shifting_terms, CAST(least(round_even(a * 50, 0), 5.0) AS BIGINT) AS trend_bar,
  row_number() OVER (ORDER BY a DESC, category) AS rank
FROM g"""


def _evidence_cols(src: str = "") -> str:
    p = f"{src}." if src else ""
    return (f"{p}text, {p}date AS \"at\", CAST(trunc({p}severity) AS INTEGER) AS score, {p}user_tier, "
            f"{p}value_weight, {p}app_version, CAST({p}upvotes AS BIGINT) AS upvotes")


def issue_reviews_sql(issue: str, n: int, top: int = 100) -> str:
    iss = issue.strip().replace("'", "''")
    cond = f"trim(category) = '{iss}'" + (" AND date IS NOT NULL AND date <> ''" if n > 0 else "")
    months = (f"""m2 AS (SELECT * FROM m WHERE date IN (
    SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date DESC) AS rk FROM (SELECT DISTINCT date FROM m) x) y
    WHERE rk <= {n}))""" if n > 0 else "m2 AS (SELECT * FROM m)")
    win = f"Last {n}M" if n > 0 else "All Time"
    return "WITH " + ",\n".join(base_ctes()) + f"""
, m AS (SELECT * FROM fx_classified WHERE {cond}),
{months},
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY confidence DESC, text) AS pr
                     FROM m2 WHERE length(text) > 20) x WHERE pr = 1),
r AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, text) AS rk FROM d)
SELECT rk AS rank, {_evidence_cols()}, (SELECT count(*) FROM m2) AS total_in_window, '{win}' AS window
FROM r WHERE rk <= {top}"""


def diagnostic_evidence_sql(month: str | None, topic: str | None, aspect: str | None, top: int = 100) -> str:
    conds = ["true"]
    if month:
        conds.append(f"contains(date, '{month}')")
    if topic:
        conds.append(f"(coalesce(regexp_matches(category, '(?i){topic}'), false) OR "
                     f"coalesce(regexp_matches(text, '(?i){topic}'), false))")
    if aspect:
        conds.append(f"category IN ({', '.join(repr(x) for x in C.ASPECT_MAP.get(aspect, []))})")
    return "WITH " + ",\n".join(base_ctes()) + f"""
, r AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, text) AS rk FROM fx_classified WHERE {' AND '.join(conds)})
SELECT rk AS rank, 'enriched-' || substr(md5(text), 1, 12) AS id, {_evidence_cols()} FROM r WHERE rk <= {top}"""


def live_ticker_sql(n: int = 15) -> str:
    return "WITH " + fx_reviews_cte() + f"""
, t AS (SELECT *, row_number() OVER (ORDER BY "at" DESC NULLS LAST, reviewId) AS rk FROM fx_reviews)
SELECT rk AS rank, reviewId AS id, substr(content, 1, 200) AS text, coalesce(sentiment, 'neutral') AS sentiment, "at"
FROM t WHERE rk <= {n} AND length(content) >= 30"""


def reviews_head_sql(n: int = 50) -> str:
    return "WITH " + fx_reviews_cte() + f"""
SELECT * FROM fx_reviews ORDER BY TRY_CAST(reviewId AS BIGINT) NULLS LAST, reviewId LIMIT {n}"""


def export_projection_sql(n: int) -> str:
    return "WITH " + fx_reviews_cte() + f"""
SELECT reviewId, content, score, sentiment, "at", app, appVersion FROM fx_reviews
WHERE "at" >= TIMESTAMP '{AS_OF}' - INTERVAL {n} MONTH"""


def metrics_body(src: str, t: str, p: str) -> str:
    return f"""
, m_conf AS (SELECT CAST({t} AS VARCHAR) AS t, CAST({p} AS VARCHAR) AS p, count(*) AS c FROM {src} GROUP BY 1, 2),
m_t AS (SELECT t AS label, sum(c) AS support, sum(CASE WHEN t = p THEN c END) AS tp FROM m_conf GROUP BY 1),
m_p AS (SELECT p AS label, sum(c) AS predicted FROM m_conf GROUP BY 1),
m_j AS (SELECT coalesce(a.label, b.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
               coalesce(predicted, 0) AS predicted FROM m_t a FULL JOIN m_p b ON a.label = b.label),
m_j2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
                   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM m_j),
m_j3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m_j2)
SELECT label, round(prec, 4) AS precision, round(rec, 4) AS recall, round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM m_j3
UNION ALL SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), round(sum(tp) / sum(support), 4),
  CAST(sum(support) AS BIGINT) FROM m_j3
UNION ALL SELECT 'macro avg', round(avg(prec), 4), round(avg(rec), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM m_j3
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / sum(support), 4), round(sum(rec * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM m_j3"""


def classifier_metrics_sql() -> str:
    cls = semantic_classify_sql().split("\nSELECT vec_id, category, cc AS best_label")[0]
    return cls + """
, cls AS (SELECT vec_id, category, CASE WHEN s >= 0.3 THEN cc ELSE 'General App Feedback' END AS predicted FROM best)""" + \
        metrics_body("cls", "category", "predicted")


def _hash_pct(expr: str, seed: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}' || CAST({expr} AS VARCHAR)), 1, 8) AS BIGINT) % 100)"


def eval_centroids_sql() -> str:
    return "WITH " + ",\n".join([
        fx_vectors_cte(),
        f"sp AS (SELECT *, CASE WHEN {_hash_pct('vec_id', 42)} < 20 THEN 'test' ELSE 'train' END AS split FROM fx_vectors)",
        "tr AS (SELECT * FROM sp WHERE split = 'train')",
        centroids_cte("tr", "category", "embedding")]) + f"""
, te AS (SELECT vec_id, category, {_norm_sql('embedding')} AS u FROM sp WHERE split = 'test'),
sims AS (SELECT te.vec_id, te.category, c.category AS cc, list_dot_product(te.u, c.centroid) AS s FROM te CROSS JOIN cents c),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cc) AS r FROM sims) x WHERE r = 1),
pred AS (SELECT category, cc AS predicted FROM best)""" + metrics_body("pred", "category", "predicted")


def model_comparison_sql(rounds: int = 100) -> str:
    from vocspark.operators.ml import POISSON_1
    u = "CAST('0x' || substr(md5('42' || concat_ws(':', round, k)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
    weight = " + ".join(f"CASE WHEN u >= {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in POISSON_1)
    best = lambda name, cents: f"""{name} AS (SELECT vec_id, cc FROM (
  SELECT te.vec_id, c.category AS cc, row_number() OVER (PARTITION BY te.vec_id ORDER BY list_dot_product(te.u, c.centroid) DESC, c.category) AS r
  FROM te CROSS JOIN {cents} c) x WHERE r = 1)"""  # noqa: E731
    return "WITH " + ",\n".join([
        fx_vectors_cte(),
        f"sp AS (SELECT *, CASE WHEN {_hash_pct('vec_id', 42)} < 20 THEN 'test' ELSE 'train' END AS split FROM fx_vectors)",
        "tr AS (SELECT * FROM sp WHERE split = 'train')",
        "fi AS (SELECT category, arg_min(embedding, vec_id) AS embedding FROM tr GROUP BY 1)",
        centroids_cte("tr", "category", "embedding"), centroids_cte("fi", "category", "embedding", "firsts"),
        f"te AS (SELECT vec_id, category, {_norm_sql('embedding')} AS u FROM sp WHERE split = 'test')",
        best("pa", "firsts"), best("pb", "cents")]) + f"""
, rows AS (SELECT te.vec_id::VARCHAR AS k, CAST(te.category = pa.cc AS INTEGER) AS a, CAST(te.category = pb.cc AS INTEGER) AS b
  FROM te JOIN pa USING (vec_id) JOIN pb USING (vec_id)),
draws AS (SELECT *, {u} AS u FROM rows CROSS JOIN range(1, {rounds} + 1) t(round)),
weighed AS (SELECT round, a, b, {weight} AS w FROM draws),
per AS (SELECT round, sum(w * (b - a)) / sum(w) AS d FROM weighed GROUP BY round HAVING sum(w) > 0),
sorted AS (SELECT list(d ORDER BY d) AS d FROM per),
whole AS (SELECT count(*) AS n, round(sum(a) / count(*), 4) AS baseline, round(sum(b) / count(*), 4) AS candidate,
  round((sum(b) - sum(a)) / count(*), 4) AS delta, count(*) FILTER (b > a) AS better, count(*) FILTER (b < a) AS worse FROM rows)
SELECT whole.*, round(d[greatest(ceil(len(d) * 0.025), 1)::INTEGER], 4) AS delta_low,
  round(d[greatest(ceil(len(d) * 0.975), 1)::INTEGER], 4) AS delta_high FROM whole, sorted"""


def bootstrap_cte(cap: int | None = 300) -> str:
    return f"""boot AS (
  SELECT text AS review, category FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, text) AS rk FROM fx_classified
    WHERE confidence IS NOT NULL AND confidence >= 0.0 AND category <> '{C.FALLBACK_LABEL}'
      AND text IS NOT NULL AND trim(text) <> '') x
  {"" if cap is None else f"WHERE rk <= {cap}"}
)"""


def bootstrap_labels_sql() -> str:
    return "WITH " + ",\n".join(base_ctes() + [bootstrap_cte()]) + "\nSELECT review, category FROM boot"


def label_coverage_sql() -> str:
    vals = ", ".join(f"('{x}')" for x in C.TAXONOMY_LABELS)
    return "WITH " + ",\n".join(base_ctes() + [bootstrap_cte(None)]) + f"""
, tax(category) AS (VALUES {vals}),
cnt AS (SELECT category, count(*) AS n FROM boot GROUP BY 1)
SELECT tax.category, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n FROM tax LEFT JOIN cnt ON tax.category = cnt.category"""


def triplets_sql(cap: int = 500, seed: int = 42, eval_pct: int = 10) -> str:
    draw = f"CAST('0x' || substr(md5('{seed + 2}' || a.t), 1, 8) AS BIGINT)"
    return "WITH " + ",\n".join(base_ctes() + [bootstrap_cte()]) + f"""
, r AS (SELECT review AS t, category AS c, row_number() OVER (PARTITION BY category ORDER BY md5('{seed}' || review), review) - 1 AS rk,
               count(*) OVER (PARTITION BY category) AS sz FROM boot),
cls AS (SELECT c, sum(sz) OVER (ORDER BY md5('{seed}' || c), c) - sz AS start, sum(sz) OVER () AS total
        FROM (SELECT DISTINCT c, sz FROM r) d),
placed AS (SELECT r.*, cls.start, cls.total, cls.start + r.rk AS pos FROM r JOIN cls ON r.c = cls.c),
a AS (SELECT * FROM placed WHERE sz > 1 AND rk < {cap} AND total > sz),
drawn AS (SELECT a.*, {draw} % (total - sz) AS d FROM a)
SELECT x.t AS anchor, p.t AS positive, n.t AS negative, x.c AS category,
  CASE WHEN {_hash_pct('x.t', seed + 1)} < {eval_pct} THEN 'eval' ELSE 'train' END AS split
FROM drawn x JOIN placed p ON p.pos = x.start + (x.rk + 1) % x.sz
JOIN placed n ON n.pos = CASE WHEN x.d < x.start THEN x.d ELSE x.d + x.sz END"""


def stream_daily_sql() -> str:
    return """SELECT date_trunc('day', ts) AS day, event_type AS category, count(*) AS reviews,
  CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS severity_sum FROM events GROUP BY 1, 2"""


def stream_weekly_sql() -> str:
    return """SELECT ws AS window_start, event_type AS category, ws + INTERVAL 7 DAY AS window_end, count(*) AS reviews
FROM (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS ws, event_type FROM events, range(0, 7) r(k)) x
GROUP BY 1, 2, 3"""


def stream_ticker_sql(n: int = 15) -> str:
    return f"""SELECT * FROM (
  SELECT CAST(event_id AS VARCHAR) AS reviewId, event_type AS category, ts AS "at", props AS content,
         row_number() OVER (ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS rank FROM events) x WHERE rank <= {n}"""


def stream_monthly_sql() -> str:
    return """SELECT strftime(ts, '%Y-%m') AS month, event_type AS category, count(*) AS reviews,
  CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS severity_sum FROM events GROUP BY 1, 2"""


def severity_sql(text: str, ws: str, l5, l4, l3) -> str:
    return f"""least(round(2.0
      + (CASE WHEN len(list_intersect({ws}, {_sql_list(l5)})) > 0 THEN 2.5
              WHEN len(list_intersect({ws}, {_sql_list(l4)})) > 0 THEN 1.5
              WHEN len(list_intersect({ws}, {_sql_list(l3)})) > 0 THEN 0.5 ELSE 0.0 END)
      + (CASE WHEN length(regexp_replace({text}, '[^\\p{{Lu}}]', '', 'g')) / greatest(length({text}), 1) > 0.3 THEN 0.5 ELSE 0.0 END)
      + least((length({text}) - length(replace({text}, '!', ''))) * 0.2, 0.6), 2), 5.0)"""


def score_batch_ctes() -> list[str]:
    FX = _fx()
    w = f"round({_tier_weight_case('r.user_tier')} * (CASE WHEN TRY_CAST(r.clv AS DOUBLE) > 0 THEN 1.0 + ln(1.0 + TRY_CAST(r.clv AS DOUBLE) / 100.0) ELSE 1.0 END), 2)"
    sev = severity_sql("r.content", "r.ws", FX.FX_SEVERITY_5, FX.FX_SEVERITY_4, FX.FX_SEVERITY_3)
    return [fx_reviews_cte(), docs_valid_cte(), fx_vectors_cte(), centroids_cte("fx_vectors", "category", "embedding"),
            f"""emb AS (SELECT vec_id, {_norm_sql('list_transform(embedding, lambda x: CAST(x AS DOUBLE))')} AS u FROM embeddings),
sr AS (
  SELECT fr.*, emb.u FROM fx_reviews fr JOIN docs_valid v ON v.doc_id = fr.doc_id AND v.is_valid
  JOIN emb ON emb.vec_id = fr.doc_id % (SELECT count(*) FROM embeddings) WHERE fr.sentiment = 'negative'
),
ssims AS (SELECT sr.reviewId, c.category AS cc, list_dot_product(sr.u, c.centroid) AS d FROM sr CROSS JOIN cents c),
sbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reviewId ORDER BY d DESC, cc) AS rn FROM ssims) x WHERE rn = 1),
r AS (SELECT sr.*, sbest.d, sbest.cc, list_distinct({_words_sql('sr.content')}) AS ws FROM sr JOIN sbest ON sr.reviewId = sbest.reviewId),
scored AS (
  SELECT r.content AS text, CASE WHEN r.d >= 0.3 THEN r.cc ELSE '{C.FALLBACK_LABEL}' END AS category, r.d AS confidence,
    strftime(r."at", '%Y-%m') AS date, CAST({sev} AS DOUBLE) AS severity, CAST({w} AS DOUBLE) AS value_weight,
    r.appVersion AS app_version, CAST(r.thumbsUpCount AS BIGINT) AS upvotes, r.reviewId, r.u
  FROM r
),
scored2 AS (
  SELECT *, CAST(round(CAST(severity AS DECIMAL(12,2)) * CAST(value_weight AS DECIMAL(12,2)), 2) AS DOUBLE) AS financial_impact
  FROM scored
)""", fx_timeseries_cte("scored2", "sb_ts", "sb_g")]


def score_batch_timeseries_sql() -> str:
    return "WITH " + ",\n".join(score_batch_ctes()) + "\nSELECT * FROM sb_ts"


def score_batch_classifications_sql() -> str:
    return "WITH " + ",\n".join(score_batch_ctes()) + """
SELECT text, category, date, severity, value_weight, financial_impact, round(confidence, 4) AS confidence, app_version, upvotes
FROM scored2"""


def score_batch_quality_sql() -> str:
    return "WITH " + ",\n".join(score_batch_ctes()) + _silhouette_body("SELECT reviewId AS id, category AS l, u FROM scored2")


def score_batch_drift_sql() -> str:
    source = score_batch_ctes() + ["sb_sem AS (SELECT text, category, date AS month, u AS embedding FROM scored2)"]
    return "WITH " + ",\n".join(drift_ctes(source, "sb_sem")) + "\nSELECT * FROM drift"


def score_batch_uploaded_sql() -> str:
    return "WITH " + fx_reviews_cte() + "\nSELECT *, lower(content) AS cleaned_content FROM fx_reviews"


def score_batch_topics_sql(candidates: int = 20, keep: int = 15, threshold: float = 0.85) -> str:
    """Twenty most confident texts of a category, walked from the one nearest to its centroid, without near copies."""
    dup = f"coalesce(list_bool_or(list_transform(w.us, lambda k: list_dot_product(k, r.u) >= {threshold})), false)"
    return "WITH RECURSIVE " + ",\n".join(score_batch_ctes()) + f"""
, cand AS (SELECT * FROM (
    SELECT category, text, confidence, u, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, text) AS o
    FROM scored2 WHERE length(text) > 40) e WHERE o <= {candidates}),
ranked AS (
  SELECT c.category, c.text, c.u, row_number() OVER (PARTITION BY c.category
    ORDER BY list_dot_product(c.u, a.centroid) DESC NULLS LAST, c.confidence DESC, c.text) AS rk
  FROM cand c LEFT JOIN cents a ON a.category = c.category),
walk AS (
  SELECT category, 0::BIGINT AS rk, []::VARCHAR[] AS kept, []::DOUBLE[][] AS us FROM (SELECT DISTINCT category FROM ranked) g
  UNION ALL
  SELECT w.category, r.rk,
    CASE WHEN len(w.kept) < {keep} AND NOT {dup} THEN list_append(w.kept, r.text) ELSE w.kept END,
    CASE WHEN len(w.kept) < {keep} AND NOT {dup} THEN list_append(w.us, r.u) ELSE w.us END
  FROM walk w JOIN ranked r ON r.category = w.category AND r.rk = w.rk + 1),
ev AS (SELECT category AS label, kept AS sample_reviews FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY rk DESC) AS o FROM walk) x WHERE o = 1)
SELECT s.label AS topic_id, s.label AS keywords, s.label, CAST(s.mentions AS BIGINT) AS mentions, s.avg_severity,
  coalesce(ev.sample_reviews, []) AS sample_reviews
FROM (SELECT category AS label, count(*) AS mentions, round(avg(severity), 2) AS avg_severity FROM scored2 GROUP BY 1) s
LEFT JOIN ev ON ev.label = s.label"""


def preprocess_training_sql() -> str:
    clean = clean_text_sql().split("SELECT doc_id, ")[1].split("\nFROM documents")[0]
    clean = clean.replace("coalesce(text, '')", "coalesce(content, '')")
    return "WITH " + fx_reviews_cte() + f"""
, c AS (SELECT content, score, {clean} FROM fx_reviews WHERE content IS NOT NULL AND trim(content) <> '')
SELECT content, score, cleaned_content FROM c WHERE trim(cleaned_content) <> ''"""


def drift_watchlist_sql(top: int = 6) -> str:
    return "WITH " + ",\n".join(drift_ctes()) + f"""
, g AS (SELECT category, avg(drift_score) AS a, avg(CAST(round(drift_score * 10000) AS BIGINT)) AS au,
               arg_max(shifting_terms, month_from || '|' || month_to) AS terms FROM drift GROUP BY category),
r AS (SELECT *, row_number() OVER (ORDER BY a DESC, category) AS rank FROM g)
SELECT category, round(au / 100, 0) / 100 AS score, coalesce(terms, 'stable') AS terms, rank FROM r WHERE rank <= {top}"""


def topic_rates_by_label_sql() -> str:
    cases = " ".join(f"WHEN category = '{t}' THEN '{n}'" for t, n in _fx().FX_TOPIC_LABELS.items())
    return "WITH " + ",\n".join(base_ctes()) + f"""
, c AS (SELECT * FROM fx_classified WHERE date IS NOT NULL AND date <> ''),
mn AS (SELECT category AS topic_id, CASE {cases} ELSE category END AS issue_label, date AS month, count(*) AS mentions FROM c GROUP BY 1, 2, 3),
st AS (SELECT category, date AS month, sum(severity) AS sev_sum, CAST(sum(CAST(financial_impact AS DECIMAL(18,2))) AS DOUBLE) AS impact_sum
  FROM c WHERE severity >= 4.5 GROUP BY 1, 2),
j AS (SELECT mn.*, sum(mentions) OVER (PARTITION BY mn.month) AS total,
    coalesce(l.sev_sum, t.sev_sum, mentions * 2.0) AS sev, coalesce(l.impact_sum, t.impact_sum, CAST(mentions * 2.0 AS DOUBLE)) AS imp
  FROM mn LEFT JOIN st l ON l.category = mn.issue_label AND l.month = mn.month LEFT JOIN st t ON t.category = mn.topic_id AND t.month = mn.month)
SELECT topic_id, issue_label, month, CAST(mentions AS BIGINT) AS mentions, round(mentions / greatest(total, 1) * 1000, 2) AS normalized_rate,
  round(sev / greatest(total, 1) * 1000, 2) AS severity_weighted_rate, round(imp / greatest(total, 1) * 1000, 2) AS revenue_risk_score,
  CAST(total AS BIGINT) AS total_reviews_in_month FROM j"""


def _strip_sql(t: str) -> str:
    for pattern, to in ((r"\*\*(.*?)\*\*", r"\1"), (r"\*(.*?)\*", r"\1"), (r"(?m)^>\s?", ""), (r"(?m)^-\s?", ""), (r"\s{2,}", " ")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"trim({t})"


def summary_fields_sql() -> str:
    part = lambda cond: f"list_filter(s, lambda p: {cond})[1]"
    plain = lambda p: _strip_sql(f"coalesce(array_to_string({p}.lines, ' '), '')")
    line = lambda start: f"list_filter(health, lambda t: starts_with(t, '{start}'))[1]"
    heading = _strip_sql(r"regexp_replace(trim(x[1]), '^###\s*', '')")
    return rf"""WITH es AS ({executive_summary_sql(0)}),
parts AS (SELECT list_transform(string_split_regex(summary, '\n-{{3,}}\n'),
  lambda p: list_filter(string_split(p, chr(10)), lambda x: trim(x) <> '')) AS ps FROM es),
secs AS (SELECT list_transform(list_filter(ps, lambda x: len(x) > 0), lambda x: struct_pack(heading := {heading}, lines := x[2:])) AS s FROM parts),
pick AS (SELECT coalesce({part("starts_with(p.heading, 'Primary Focus')")}, s[1]) AS f, {part("p.heading = 'Suggested Action'")} AS a,
  {part("p.heading = 'General App Health'")} AS h, {part("p.heading = 'What Customers are Saying'")} AS v FROM secs),
st AS (SELECT *, coalesce(list_transform(h.lines, lambda x: {_strip_sql("x")}), []) AS health,
  trim(regexp_replace(f.heading, '^[^:]*:', '')) AS topic, {plain("v")} AS quote FROM pick)
SELECT CASE WHEN coalesce(topic, '') = '' THEN 'Executive Focus' ELSE topic END AS focus_topic,
  regexp_replace({plain("f")}, '(?i)^Current Situation:\s*', '') AS focus_summary,
  regexp_replace({plain("a")}, '(?i)^(Action|Urgent|Standard):\s*', '') AS action_summary,
  coalesce({line("Status:")}, 'Status: Monitoring is active.') AS status_line, coalesce({line("Watch Out:")}, '') AS watch_line,
  list_filter(health, lambda t: NOT (starts_with(t, 'Status:') OR starts_with(t, 'Category Performance:') OR starts_with(t, 'Watch Out:')))[1:3] AS category_lines,
  CASE WHEN quote = '' THEN 'No representative customer quote was available.' ELSE quote END AS voice_quote
FROM st"""


def display_texts_sql() -> str:
    plain = "''''" + '""--'  # two quotes (doubled in SQL), two double quotes, two dashes
    return rf"""SELECT doc_id,
  regexp_replace(replace(translate(text, '‘’“”–—', '{plain}'), '…', '...'), '[^\x{{00}}-\x{{ff}}]', '', 'g') AS report_text,
  regexp_replace(CASE WHEN length(t) > 180 THEN substr(t, 1, 177) || '...' ELSE t END, '(?i)(thou|thing)', '<mark>\1</mark>', 'g') AS marked
FROM (SELECT doc_id, text, replace(text, chr(10), ' ') AS t FROM documents)"""


def source_lists_sql() -> str:
    return "SELECT doc_id, CASE WHEN lang IS NOT NULL AND source IS NOT NULL THEN [lang, source] END AS items FROM documents"


def alert_texts_sql() -> str:
    return rf"""WITH al AS ({report_alerts_sql(0)}),
x AS (SELECT category, rank, message, regexp_extract(message, '([+-]?[0-9]+(?:\.[0-9]+)?)%', 1) AS pct,
  regexp_extract(message, 'Limit: ([0-9]+(?:\.[0-9]+)?)', 1) AS lim FROM al)
SELECT category, rank, CASE WHEN lim <> '' THEN 'Running above its normal range (limit ' || lim || ')'
  WHEN pct <> '' THEN 'Mentions changed by ' || pct || '% versus the previous period' ELSE message END AS text FROM x"""


def significant_issues_sql() -> str:
    return f"""WITH tp AS ({topic_stats_sql()}),
x AS (SELECT label, mentions FROM tp WHERE mentions >= 0.02 * (SELECT max(mentions) FROM tp)),
r AS (SELECT *, row_number() OVER (ORDER BY mentions DESC, label) AS rank FROM x)
SELECT * FROM r WHERE rank <= 10"""


def drift_bands_sql() -> str:
    return f"""SELECT category, score, round(least(score * 420, 100.0), 4) AS intensity,
  CASE WHEN score > 0.18 THEN 'Shifting' WHEN score > 0.14 THEN 'Evolving' ELSE 'Stable' END AS state, rank
FROM ({drift_watchlist_sql()})"""


def stability_band_sql() -> str:
    return f"""SELECT latest_month, volatility_count, greatest(0, 100 - 20 * volatility_count) AS index,
  CASE WHEN 100 - 20 * volatility_count > 90 THEN 'Stable' WHEN 100 - 20 * volatility_count > 70 THEN 'Watch' ELSE 'Volatile' END AS band
FROM ({report_stability_sql()})"""


def trend_tags_sql() -> str:
    return f"""WITH tl AS ({trending_sql(0)}),
a AS (SELECT * FROM tl WHERE NOT is_forecast),
b AS (SELECT *, lag(value) OVER (PARTITION BY issue_label ORDER BY month) AS pv FROM a),
c AS (SELECT *, CASE WHEN pv IS NULL OR pv = 0 THEN 'New' WHEN (value - pv) / pv * 100 > 10 THEN 'Rising'
                     WHEN (value - pv) / pv * 100 < -10 THEN 'Cooling' ELSE 'Stable' END AS trend FROM b),
l AS (SELECT issue_label, value AS latest FROM (
        SELECT *, row_number() OVER (PARTITION BY issue_label ORDER BY month DESC) AS rd FROM a) x WHERE rd = 1),
lr AS (SELECT issue_label, row_number() OVER (ORDER BY latest DESC, issue_label) AS visible_rank FROM l)
SELECT c.month, c.issue_label, c.value, c.trend, lr.visible_rank FROM c JOIN lr ON c.issue_label = lr.issue_label"""


def semantic_search_recent_sql(n: int = 3, top: int = 15) -> str:
    return "WITH " + ",\n".join([fx_reviews_cte(), fx_vectors_cte()]) + f"""
, q AS (SELECT {_norm_sql('embedding')} AS qv FROM fx_vectors WHERE vec_id = 0),
emb AS (SELECT vec_id, {_norm_sql('list_transform(embedding, lambda x: CAST(x AS DOUBLE))')} AS u FROM embeddings),
r AS (SELECT fr.reviewId, fr.content, list_dot_product(emb.u, (SELECT qv FROM q)) AS score
      FROM fx_reviews fr JOIN emb ON emb.vec_id = fr.doc_id % (SELECT count(*) FROM embeddings)
      WHERE fr."at" >= TIMESTAMP '{AS_OF}' - INTERVAL {n} MONTH),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, reviewId) AS rank FROM r)
SELECT rank, reviewId, content, round(score, 6) AS confidence FROM k WHERE rank <= {top}"""


def stream_velocity_sql() -> str:
    return f"""WITH wk AS ({stream_weekly_sql()}),
l AS (SELECT max(window_start) + INTERVAL 1 DAY AS e FROM wk),
cur AS (SELECT category, reviews AS c, window_end FROM wk, l WHERE window_end = l.e),
prev AS (SELECT category, reviews AS p FROM wk, l WHERE window_end = l.e - INTERVAL 7 DAY),
j AS (SELECT cur.*, prev.p, round((c - p) / p * 100, 1) AS velocity_pct FROM cur JOIN prev USING (category) WHERE p > 0),
s AS (SELECT *, CASE WHEN velocity_pct >= 40 THEN 'CRITICAL' WHEN velocity_pct >= 20 THEN 'HIGH'
                     WHEN velocity_pct >= 10 THEN 'WATCH' END AS severity FROM j)
SELECT category, window_end, c AS curr_reviews, p AS prev_reviews, velocity_pct, severity FROM s"""


def stratified_split_sql() -> str:
    h = "CAST('0x' || substr(md5('42' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)"
    return f"""WITH lab AS (
  SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h}, doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM lab)
SELECT doc_id, label, CASE WHEN rn <= round(n * 20 / 100.0) THEN 'test' ELSE 'train' END AS split FROM r"""


def profile_ctes() -> list[str]:
    from vocspark.operators.language import PROFILE_SIZE, SHORT
    grams = f"""unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: substr('_' || w || '_', i, 3)),
      CASE WHEN length(w) <= {SHORT} THEN ['_' || w || '_'] ELSE [] END)) AS gram"""
    return [f"""lw AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) AS w FROM documents),
lg AS (SELECT doc_id, lang, {grams} FROM lw),
lc AS (SELECT lang, gram, count(*) AS n FROM lg WHERE lang IS NOT NULL GROUP BY 1, 2),
profiles AS (SELECT lang, gram, CAST({PROFILE_SIZE} + 1 - rk AS BIGINT) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rk FROM lc) x WHERE rk <= {PROFILE_SIZE})""",
            """scores AS (SELECT g.doc_id, p.lang, sum(p.weight) AS score FROM lg g JOIN profiles p ON g.gram = p.gram GROUP BY 1, 2),
detected AS (SELECT doc_id, arg_max(lang, (score, lang)) AS detected, CAST(max(score) AS BIGINT) AS score FROM scores GROUP BY 1)"""]


def language_profiles_sql() -> str:
    return "WITH " + profile_ctes()[0] + "\nSELECT * FROM profiles"


def language_gate_sql() -> str:
    return "WITH " + ",\n".join(profile_ctes()) + """
SELECT d.doc_id, d.lang, x.detected, coalesce(x.score, 0) AS score FROM documents d LEFT JOIN detected x ON d.doc_id = x.doc_id"""


def valid_reviews_detected_sql() -> str:
    return "WITH " + ",\n".join(profile_ctes() + [
        "docs_lang AS (SELECT d.doc_id, d.text, x.detected FROM documents d LEFT JOIN detected x ON d.doc_id = x.doc_id)",
        docs_valid_cte("docs_lang", lang="detected")]) + "\nSELECT doc_id, is_valid FROM docs_valid"


def lemma_ctes() -> list[str]:
    from vocspark.operators.lemmas import MIN_COUNT, MIN_STEM, SUFFIX_RULES
    made = ", ".join(f"CASE WHEN regexp_matches(word, '{p}') THEN regexp_replace(word, '{p}', '{r.replace('$', chr(92))}') END"
                     for p, r in SUFFIX_RULES)
    return [f"""words AS (SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents) u GROUP BY 1),
proposed AS (SELECT DISTINCT word AS form, n AS form_count, stem FROM (SELECT word, n, unnest([{made}]) AS stem FROM words) p
  WHERE stem IS NOT NULL AND length(stem) >= {MIN_STEM} AND stem <> word),
lemmas AS (SELECT form, lemma, form_count, lemma_count FROM (
  SELECT form, stem AS lemma, form_count, k.n AS lemma_count,
    row_number() OVER (PARTITION BY form ORDER BY k.n DESC, length(stem), stem) AS rn
  FROM proposed JOIN words k ON k.word = stem AND k.n >= {MIN_COUNT}) x WHERE rn = 1)"""]


def lemma_map_sql() -> str:
    return "WITH " + lemma_ctes()[0] + "\nSELECT form, lemma, form_count, lemma_count FROM lemmas"


def lemmatised_text_sql() -> str:
    from vocspark.functions.text import STOP_WORDS
    t = "regexp_replace(regexp_replace(lower(coalesce(text, '')), 'http\\S+|www\\S+', '', 'g'), '[^a-zA-Z\\s]', '', 'g')"
    return "WITH " + lemma_ctes()[0] + f""",
cleaned AS (SELECT doc_id, list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '' AND NOT list_contains({_sql_list(STOP_WORDS)}, w)) AS ws
  FROM documents),
tok AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM cleaned),
joined AS (SELECT tok.doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS t FROM tok LEFT JOIN lemmas ON lemmas.form = tok.w GROUP BY 1)
SELECT c.doc_id, coalesce(j.t, '') AS lemmatised FROM cleaned c LEFT JOIN joined j ON c.doc_id = j.doc_id"""


def all_sql() -> dict[str, str]:
    return {
        "monthly_rates": monthly_rates_sql(),
        "topic_stats": topic_stats_sql(),
        "top_issues_3m": top_issues_sql(3),
        "top_issues_all": top_issues_sql(0),
        "sentiment_distribution": sentiment_distribution_sql(3),
        "kpis": kpis_sql(3),
        "kpis_all": kpis_sql(0),
        "aspects_3m": aspects_map_sql(3),
        "aspect_mentions": aspect_mentions_sql(),
        "threshold_alerts": threshold_alerts_sql(),
        "trending_long": trending_sql(0),
        "trending_3m": trending_sql(3),
        "trending_6m_revenue": trending_sql(6, "revenue"),
        "issue_correlation": issue_correlation_sql(0, -1.0),
        "velocity_alerts": velocity_alerts_sql(3),
        "intelligence_alerts": intelligence_alerts_sql(3),
        "sentiment_stability": sentiment_stability_sql(0),
        "sentiment_stability_6m": sentiment_stability_sql(6),
        "report_alerts": report_alerts_sql(3),
        "report_alerts_all": report_alerts_sql(0),
        "report_aspects": report_aspects_sql(3),
        "report_stability": report_stability_sql(),
        "report_movers": report_movers_sql(12),
        "report_sentiment": report_sentiment_sql(3),
        "report_kpis": report_kpis_sql(3),
        "report_top_issues": report_top_issues_sql(3),
        "text_scores": text_scores_sql(),
        "valid_reviews": valid_reviews_sql(),
        "clean_text": clean_text_sql(),
        "stratified_split": stratified_split_sql(),
        "language_profiles": language_profiles_sql(),
        "language_gate": language_gate_sql(),
        "valid_reviews_detected": valid_reviews_detected_sql(),
        "lemma_map": lemma_map_sql(),
        "lemmatised_text": lemmatised_text_sql(),
        "value_weight": value_weight_sql(),
        "hash_tier": hash_tier_sql(),
        "cluster_keywords": cluster_keywords_sql(),
        "keyword_titles": keyword_titles_sql(),
        "category_centroids": category_centroids_sql(),
        "semantic_classify": semantic_classify_sql(),
        "semantic_search": semantic_search_sql(),
        "semantic_search_recent": semantic_search_recent_sql(),
        "silhouette": silhouette_sql(),
        "semantic_drift": semantic_drift_sql(),
        "semantic_drift_summary": semantic_drift_summary_sql(),
        "shifting_terms": shifting_terms_sql(),
        "issue_reviews_3m": issue_reviews_sql("UI & Navigation", 3),
        "issue_reviews_all": issue_reviews_sql("Customer Support", 0),
        "diagnostic_evidence": diagnostic_evidence_sql("2000", "login|billing", None),
        "diagnostic_evidence_aspect": diagnostic_evidence_sql("2001-0", None, "Performance/Technical"),
        "live_ticker": live_ticker_sql(),
        "reviews_head": reviews_head_sql(),
        "export_projection": export_projection_sql(3),
        "classifier_metrics": classifier_metrics_sql(),
        "bootstrap_labels": bootstrap_labels_sql(),
        "label_coverage": label_coverage_sql(),
        "near_dup_evidence": near_dup_evidence_sql(),
        "executive_summary": executive_summary_sql(0),
        "executive_summary_6m": executive_summary_sql(6),
        "triplets": triplets_sql(),
        "eval_centroids": eval_centroids_sql(),
        "model_comparison": model_comparison_sql(),
        "stream_daily_counts": stream_daily_sql(),
        "stream_weekly_counts": stream_weekly_sql(),
        "stream_ticker": stream_ticker_sql(),
        "stream_monthly_rollup": stream_monthly_sql(),
        "stream_weekly_velocity": stream_velocity_sql(),
        "score_batch_timeseries": score_batch_timeseries_sql(),
        "score_batch_classifications": score_batch_classifications_sql(),
        "score_batch_topics": score_batch_topics_sql(),
        "score_batch_aspects": aspect_mentions_sql(),
        "score_batch_alerts": threshold_alerts_sql(),
        "score_batch_quality": score_batch_quality_sql(),
        "score_batch_drift": score_batch_drift_sql(),
        "score_batch_uploaded": score_batch_uploaded_sql(),
        "ingest_timeseries": score_batch_timeseries_sql(),
        "ingest_classifications": score_batch_classifications_sql(),
        "ingest_topics": score_batch_topics_sql(),
        "ingest_aspects": aspect_mentions_sql(),
        "ingest_quality": score_batch_quality_sql(),
        "ingest_alerts": threshold_alerts_sql(),
        "preprocess_training": preprocess_training_sql(),
        "topic_rates_by_label": topic_rates_by_label_sql(),
        "summary_fields": summary_fields_sql(),
        "display_texts": display_texts_sql(),
        "source_lists": source_lists_sql(),
        "alert_texts": alert_texts_sql(),
        "significant_issues": significant_issues_sql(),
        "drift_bands": drift_bands_sql(),
        "stability_band": stability_band_sql(),
        "drift_watchlist": drift_watchlist_sql(),
        "trend_tags": trend_tags_sql(),
    }
