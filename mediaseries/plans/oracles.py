"""The registered queries as ANSI SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from .queries import (
    EVERY_SIZE,
    NEGATIVE_WORDS,
    OUTLIER_LIMIT,
    POSITIVE_WORDS,
    QUARTER,
    SHORT_OFFSETS,
    TLCC_OFFSETS,
    WINDOW_OFFSETS,
    WINDOW_SIZES,
)

MEDIA = ("news", "reddit", "twitter", "telegram")
LINEITEM_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()


def _r(expr: str, digits: int = 8) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


def _day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def _keys(keys: tuple[str, ...], prefix: str = "") -> str:
    return "".join(f"{prefix}{k}, " for k in keys)


def _values(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# Shared views. Each is a CTE list that later ones extend.

POSTS = """
posts AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CASE l_returnflag WHEN 'A' THEN '"POSITIVE"' WHEN 'R' THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
         CASE WHEN l_returnflag = 'N' THEN 0e0 ELSE l_discount * 10 END AS conf,
         CASE l_linenumber % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'reddit' WHEN 2 THEN 'twitter' ELSE 'telegram' END AS medium
  FROM lineitem)"""

MARKET = """
market AS (
  SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS high, min(o_totalprice) AS low FROM orders GROUP BY 1)"""


def _daily(
    keys: tuple[str, ...] = (), limit: int | None = None, all_days: bool = False, ranged: bool = True, shared: bool = False, posts: str = POSTS
) -> str:
    """Daily frames. Each key has a range of its own, unless ``shared``."""
    k = _keys(keys)
    over = f"PARTITION BY {', '.join(keys)}" if keys else ""
    one = not keys or shared
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    spans = f"SELECT min(date) AS lo, max(date) AS hi FROM info{by}"
    market = "SELECT min(date) AS lo, max(date) AS hi FROM market"
    bounds = f"SELECT max(lo) AS lo, min(hi) AS hi FROM ({spans} UNION ALL {market})"
    if not one:
        bounds = f"SELECT {k} greatest(s.lo, m.lo) AS lo, least(s.hi, m.hi) AS hi FROM (SELECT {k} min(date) AS lo, max(date) AS hi FROM info{by}) s, ({market}) m"
    same = "WHERE " + " AND ".join(f"b.{c} = info.{c}" for c in keys) if not one else ""
    kept = f"WHERE date BETWEEN (SELECT lo FROM bounds b {same}) AND (SELECT hi FROM bounds b {same})" if ranged else ""
    conditions = [] if all_days else ["negatives IS NOT NULL", "positives IS NOT NULL"]
    if limit is not None:
        conditions.append(f"n < {limit}")
    where = f"WHERE {' AND '.join(conditions)}" if conditions else ""
    return f"""{posts}, {MARKET},
info AS (SELECT {k} date, label, count(*) AS n, avg(conf) AS conf FROM posts GROUP BY ALL),
bounds AS ({bounds}),
perday AS (
  SELECT {k} date,
         round(sum(n * CASE WHEN replace(label, '"', '') = 'POSITIVE' THEN conf ELSE -conf END) / sum(n), 12) + 0e0 AS sentiment,
         CAST(sum(n) AS BIGINT) AS n,
         CAST(sum(n) FILTER (replace(label, '"', '') = 'NEGATIVE') AS BIGINT) AS negatives,
         CAST(sum(n) FILTER (replace(label, '"', '') = 'POSITIVE') AS BIGINT) AS positives
  FROM info {kept} GROUP BY ALL),
scaled AS (SELECT *, n / CAST(max(n) OVER ({over}) AS DOUBLE) AS norm_count, (sentiment + 1) / 2 AS norm_sent FROM perday),
daily AS (SELECT * FROM scaled {where})"""


PRICES = """
prices AS (
  SELECT date, high, low, mid_price,
         (mid_price - min(mid_price) OVER ()) / nullif(max(mid_price) OVER () - min(mid_price) OVER (), 0) AS norm_mid_price
  FROM (SELECT *, (high + low) / 2 AS mid_price FROM market
        WHERE date BETWEEN (SELECT lo FROM bounds) AND (SELECT hi FROM bounds)))"""


# A keyed series meets the prices of its own range by their dates alone.
ALL_PRICES = """
prices AS (SELECT date, (high + low) / 2 AS mid_price FROM market)"""


PAIR_PRICES = """
pair_prices AS (
  SELECT o_orderpriority AS pair, CAST(o_orderdate AS DATE) AS date, (max(o_totalprice) + min(o_totalprice)) / 2 AS mid_price
  FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN (SELECT lo FROM bounds) AND (SELECT hi FROM bounds) GROUP BY 1, 2)"""


def _series(column: str, keys: tuple[str, ...] = (), source: str = "daily", prices: str = "prices") -> str:
    k = _keys(keys)
    over = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""
series AS (
  SELECT {k} date, row_number() OVER ({over}ORDER BY date) - 1 AS i, CAST({column} AS DOUBLE) AS x, mid_price AS y
  FROM {source} JOIN {prices} USING (date))"""


def _steps(offsets: range) -> str:
    return f"(SELECT unnest(range({offsets[0]}, {offsets[-1] + 1}, {offsets.step})) AS k)"


def _correlations(offsets: range, methods, keys: tuple[str, ...] = (), sizes=None) -> str:
    """CTEs ending in ``tlcc`` over a ``series`` CTE."""
    k = _keys(keys)
    ak = _keys(keys, "a.")
    on = "".join(f" AND b.{c} = a.{c}" for c in keys)
    cut = f" CROSS JOIN (SELECT unnest([{', '.join(map(str, sizes))}]) AS window_size) w" if sizes else ""
    cut_columns = "w.window_size, CAST(a.i // w.window_size AS INTEGER) AS win," if sizes else ""
    g = f"{k}{'window_size, win, ' if sizes else ''}k"
    ranks = f"""
ranked AS (
  SELECT {g}, x, y,
         rank() OVER (PARTITION BY {g} ORDER BY x) + (count(*) OVER (PARTITION BY {g}, x) - 1) / 2e0 AS rx,
         rank() OVER (PARTITION BY {g} ORDER BY y) + (count(*) OVER (PARTITION BY {g}, y) - 1) / 2e0 AS ry
  FROM pairs)"""
    parts = []
    for m in methods:
        x, y = ("x", "y") if m == "pearson" else ("rx", "ry")
        parts.append(
            f"""SELECT {g}, '{m}' AS method,
               CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END AS correlation
        FROM ranked GROUP BY {g}"""
        )
    join = ", ".join(f"'{m}'" for m in methods)
    gb = g.replace(k, "", 1) if k else g
    return f"""
shifted AS MATERIALIZED (
  SELECT {ak} {cut_columns} s.k, a.i + s.k AS j, a.x FROM series a CROSS JOIN {_steps(offsets)} s{cut}),
grid AS ({f"SELECT DISTINCT {g} FROM shifted" if keys or sizes else f"SELECT k FROM {_steps(offsets)}"}),
pairs AS (SELECT {ak} {gb}, a.x, b.y FROM shifted a JOIN series b ON b.i = a.j{on}),
{ranks},
found AS ({' UNION ALL '.join(parts)}),
methods AS (SELECT unnest([{join}]) AS method),
tlcc AS (SELECT * FROM grid CROSS JOIN methods LEFT JOIN found USING ({g}, method))"""


def _tlcc(base: str, series: str, offsets: range, methods, keys: tuple[str, ...] = (), sizes=None) -> str:
    cut = "CAST(window_size AS INTEGER) AS window_size, win AS \"window\", " if sizes else ""
    return f"""WITH {base}, {series}, {_correlations(offsets, methods, keys, sizes)}
SELECT {_keys(keys)} {cut} method, CAST(k AS INTEGER) AS "offset", {_r('correlation')} AS correlation FROM tlcc"""


def _kendall(base: str, series: str) -> str:
    return f"""WITH {base}, {series},
pairs AS MATERIALIZED (
  SELECT s.k, a.i, a.x, b.y FROM series a CROSS JOIN {_steps(TLCC_OFFSETS)} s JOIN series b ON b.i = a.i + s.k),
found AS (
  SELECT a.k, sum(sign(a.x - b.x) * sign(a.y - b.y))
              / nullif(sqrt(count(*) FILTER (a.x <> b.x) * 1e0 * count(*) FILTER (a.y <> b.y)), 0) AS tau
  FROM pairs a JOIN pairs b ON a.k = b.k AND a.i < b.i GROUP BY 1)
SELECT 'kendall' AS method, CAST(s.k AS INTEGER) AS "offset", {_r('tau')} AS correlation
FROM {_steps(TLCC_OFFSETS)} s LEFT JOIN found USING (k)"""


def _extremes(base: str, series: str) -> str:
    return f"""WITH {base}, {series}, {_correlations(TLCC_OFFSETS, ('pearson', 'spearman'))},
top AS (SELECT method, max(correlation) AS hi, min(correlation) AS lo FROM tlcc GROUP BY 1)
SELECT method, {_r('any_value(hi)')} AS max_corr,
       CAST(min(k) FILTER (correlation = hi) AS INTEGER) AS max_offset,
       {_r('any_value(lo)')} AS min_corr, CAST(min(k) FILTER (correlation = lo) AS INTEGER) AS min_offset
FROM tlcc JOIN top USING (method) WHERE hi IS NOT NULL GROUP BY method"""


DAILY = _daily()
BY_MEDIUM = _daily(("medium",))
ALL_MEDIA = _daily(("medium",), shared=True)
# One medium ends early: its later posts carry another name.
UNEVEN = _daily(("medium",), posts=POSTS.replace("WHEN 0 THEN 'news'", "WHEN 0 THEN CASE WHEN l_shipdate >= DATE '1995-01-01' THEN 'press' ELSE 'news' END"))

_DAILY_COLUMNS = f"""{_day('date')} AS date, {_r('sentiment', 10)} AS sentiment, {_r('norm_sent', 10)} AS norm_sent,
  CASE WHEN sentiment = 0 THEN 'NEUTRAL' WHEN sentiment > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
  n AS "count", {_r('norm_count', 10)} AS norm_count, negatives, positives"""

# Ties are judged at nine decimals, to the even digit, in whole numbers.
_TWO_DIGITS = """(CASE WHEN nano % 10000000 > 5000000 OR (nano % 10000000 = 5000000 AND (nano // 10000000) % 2 = 1)
  THEN nano // 10000000 + 1 ELSE nano // 10000000 END) / 100e0"""
ROUNDED = f"""
rounded AS (SELECT {_TWO_DIGITS} AS v FROM (SELECT CAST(round(norm_sent * 1e9) AS BIGINT) AS nano FROM daily))"""


def _box(source: str, value: str, key: str | None = None) -> str:
    part = f"PARTITION BY {key}" if key else ""
    group = f"{key}, " if key else ""
    name = f"{key}, " if key else ""
    return f"""
cut AS (
  SELECT {name} v, quantile_cont(v, 0.25) OVER ({part}) AS q1, quantile_cont(v, 0.5) OVER ({part}) AS median,
         quantile_cont(v, 0.75) OVER ({part}) AS q3
  FROM (SELECT {name} CAST({value} AS DOUBLE) AS v FROM {source})),
fenced AS (SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS regular FROM cut)
SELECT {name} {_r('q1')} AS q1, {_r('median')} AS median, {_r('q3')} AS q3, count(*) AS rows,
       {_r('min(v)')} AS min, {_r('max(v)')} AS max, {_r('min(v) FILTER (regular)')} AS whisker_low,
       {_r('max(v) FILTER (regular)')} AS whisker_high, count(*) FILTER (NOT regular) AS outliers
FROM fenced GROUP BY {group} q1, median, q3"""


def _bins(source: str, value: str, key: str | None = None, extent=None) -> str:
    part = f"PARTITION BY {key}" if key else ""
    name = f"{key}, " if key else ""
    first = f"DATE '{extent[0]}'" if extent else f"min(date) OVER ({part})"
    last = f"DATE '{extent[1]}'" if extent else f"max(date) OVER ({part})"
    where = f"WHERE date BETWEEN DATE '{extent[0]}' AND DATE '{extent[1]}'" if extent else ""
    return f"""
placed AS (SELECT {name} date, {value} AS v, {first} AS lo, {last} AS hi FROM {source} {where}),
binned AS (SELECT *, CAST(least((date - lo) * 100 // greatest(hi - lo, 1), 99) AS INTEGER) AS bin FROM placed)
SELECT {name} bin, {_day('min(date)')} AS first_date, {_day('max(date)')} AS last_date, count(*) AS days,
       TOTAL AS total, {_r('avg(v)', 6)} AS mean
FROM binned GROUP BY {name} bin"""


def _trend(base: str, source: str, value: str, digits: int, degree: int = 9) -> str:
    """Least squares by orthogonal polynomials built up with their three-term recurrence."""
    steps = [
        f"""
scaled_t AS (
  SELECT date, {value}, CAST({value} AS DOUBLE) AS y,
         2e0 * (date - min(date) OVER ()) / (max(date) OVER () - min(date) OVER ()) - 1 AS t FROM {source}),
p0 AS (SELECT *, 1e0 AS p, 0e0 AS prev, 0e0 AS fit, 1e0 AS prev_norm FROM scaled_t)"""
    ]
    for k in range(degree + 1):
        beta = "0e0" if k == 0 else "norm / prev_norm"
        steps.append(
            f"""
m{k} AS (SELECT *, sum(p * p) OVER () AS norm, sum(t * p * p) OVER () AS tpp, sum(y * p) OVER () AS yp FROM p{k}),
p{k + 1} AS (
  SELECT date, {value}, y, t, (t - tpp / norm) * p - {beta} * prev AS p, p AS prev, fit + yp / norm * p AS fit,
         norm AS prev_norm FROM m{k})"""
        )
    return f"""WITH {base}, {','.join(steps)}
SELECT {_day('date')} AS date, {_r('fit', digits)} AS trend FROM p{degree + 1}"""


_picks = ", ".join(
    f"max(sentiment) FILTER (medium = '{m}') AS {m}_sentiment, max(norm_count) FILTER (medium = '{m}') AS {m}_normalized_count, "
    f"max(n) FILTER (medium = '{m}') AS {m}_count"
    for m in MEDIA
)
SUMMARY = f"""{ALL_MEDIA}, {PRICES},
wide AS (SELECT date, {_picks} FROM daily GROUP BY date HAVING count(DISTINCT medium) = 4),
summary AS (
  SELECT *, (sentiment + 1) / 2 AS norm_sent
  FROM (SELECT *, round(({' + '.join(m + '_sentiment' for m in MEDIA)}) / 4, 12) + 0e0 AS sentiment,
               {' + '.join(m + '_count' for m in MEDIA)} AS n FROM wide)
  WHERE twitter_count < 100000),
media_prices AS (
  SELECT * FROM prices WHERE date BETWEEN (SELECT min(date) FROM summary) AND (SELECT max(date) FROM summary))"""


def _media_long(column: str, value: str, as_name: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {_day('date')} AS date, '{m}' AS medium, {value.format(m=m)} AS {as_name} FROM summary" for m in MEDIA
    )


USER_POSTS = """
uposts AS (
  SELECT CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS username, c_name AS full_name,
         CAST(l_partkey AS VARCHAR) AS text, CAST(l_quantity AS BIGINT) AS retweets, l_linenumber AS words
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
users AS (
  SELECT username, min(full_name) AS full_name, count(DISTINCT text) AS tweets,
         CAST(sum(retweets) AS BIGINT) AS retweets, avg(words) AS words_avg
  FROM uposts GROUP BY username)"""

RAW_TIMES = """
raw AS (
  SELECT event_id, event_id % 4 AS kind, ts FROM events)"""

# HTML clean-up in its fixed order.
_clean = "html"
for _find, _put in (
    ("&gt;", "''"), ("&#x27;", "''''"), ("&quot;", "'\"'"), ("&#x2F;", "' '"), ("<p>", "' '"),
    ("</i>", "''"), ("&#62;", "''"), ("<i>", "' '"),
):
    if _clean == "html":
        _clean = "regexp_replace(html, '<a[^>]*>.+?</a>', 'Link.', 'g')"
    _clean = f"replace({_clean}, '{_find}', {_put})"
_clean = f"replace({_clean}, chr(10), '')"


def _cleaned(column: str) -> str:
    return _clean.replace("(html,", f"({column},")


def _sentences(source: str, keys: str) -> str:
    """CTE ``sent``: one row per sentence."""
    return f"""
marked AS (
  SELECT {keys}, [s FOR s IN
           [trim(s, ' ' || chr(9) || chr(13) || chr(12)) FOR s IN
             string_split(regexp_replace({_cleaned('text')}, '([.!?]["''\\)\\]]?)[ \\t\\r\\n\\f]+', '\\1' || chr(30), 'g'), chr(30))]
           IF s <> ''] AS parts FROM {source}),
sent AS (
  SELECT {keys}, CAST(pos - 1 AS INTEGER) AS pos, parts[pos] AS sentence
  FROM (SELECT {keys}, parts, unnest(range(1, len(parts) + 1)) AS pos FROM marked))"""


_SCORED = f"""
counted AS (
  SELECT *, len([w FOR w IN words IF w IN ({_values(POSITIVE_WORDS)})]) AS p,
         len([w FOR w IN words IF w IN ({_values(NEGATIVE_WORDS)})]) AS n
  FROM (SELECT *, regexp_extract_all(lower(sentence), '\\p{{L}}+') AS words FROM sent)),
scored AS (
  SELECT * EXCLUDE (words, sentence, p, n), CASE WHEN p > n THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
         abs(p - n) / CAST(p + n AS DOUBLE) AS conf
  FROM counted WHERE p <> n)"""


def _verdicts(key: str) -> str:
    return f"""
means AS (SELECT {key}, label, round(avg(conf), 12) AS conf, min(pos) AS first FROM scored GROUP BY {key}, label),
verdicts AS (
  SELECT {key}, label, conf
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY conf DESC, first) AS place FROM means) WHERE place = 1)"""


_MODEL = """
counted AS (
  SELECT *, len(sentence) - len(replace(sentence, 'e', '')) AS p, len(sentence) - len(replace(sentence, 'a', '')) AS n
  FROM sent),
scored AS (
  SELECT * EXCLUDE (sentence, p, n), CASE WHEN p > n THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
         abs(p - n) / CAST(p + n AS DOUBLE) AS conf
  FROM counted WHERE p <> n)"""


def _classified(scored: str) -> str:
    return f"""WITH {_sentences('documents', 'doc_id')}, {scored}, {_verdicts('doc_id')}
SELECT doc_id, CASE WHEN text <> '' THEN coalesce(label, 'NEUTRAL') END AS label,
       {_r("CASE WHEN text <> '' THEN coalesce(conf, 0e0) END")} AS conf
FROM documents LEFT JOIN verdicts USING (doc_id)"""


MESSAGES = """
messages AS (
  SELECT event_id, ts, props, user_id, nullif(event_id % 7, 0) AS views,
         CASE WHEN event_id % 3 <> 0 THEN nullif(event_id % 11, 0) END AS forwards
  FROM events WHERE event_type <> 'error' AND event_id % 5 <> 0)"""

_TRIMMED = "replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\"', '')"

_DROPPED = "(?is)<!--.*?-->" + "".join(
    f"|<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "nav", "aside", "footer", "header", "noscript")
)
_BREAK = "(?i)</?(?:p|div|article|section|h[1-6]|li|ul|ol|table|tr|br|blockquote|body|html)\\b[^>]*>"


def _tidy(expr: str) -> str:
    for name, char in (
        ("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&amp;", "'&'"),
    ):
        expr = f"replace({expr}, '{name}', {char})"
    return f"trim(regexp_replace({expr}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


_TITLE_SQL = _tidy("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g')")
_BODY = f"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<title[^>]*>(.*?)</title>', '', 'g'),
  '{_DROPPED}', '', 'g'), '{_BREAK}', chr(30), 'g')"""
_PARAGRAPH = _tidy("regexp_replace(s, '(?s)<[^>]*>', '', 'g')")
_TEXT_SQL = f"""array_to_string([s FOR s IN [{_PARAGRAPH} FOR s IN string_split({_BODY}, chr(30))] IF s <> ''],
  chr(10) || chr(10))"""


def _monthly(keys: tuple[str, ...]) -> str:
    return f"""SELECT {_keys(keys)} strftime(date, '%Y-%m') AS month, {_r('avg(n)')} AS "count"
FROM daily GROUP BY ALL"""


_SENT = _series("norm_sent")
_VOL = _series("n")
_BASE = f"{DAILY}, {PRICES}"
_BASE_M = f"{BY_MEDIUM}, {ALL_PRICES}"
_MEDIA_SENT = _series("norm_sent", source="summary", prices="media_prices")
_MEDIA_VOL = _series("n", source="summary", prices="media_prices")
_BOTH = ("pearson", "spearman")

_BIN_DOUBLE, _BIN_LONG = _r("sum(v)", 6), "CAST(sum(v) AS BIGINT)"

ORACLES: dict[str, str] = {
    "daily_info": f"""WITH {POSTS}
SELECT {_day('date')} AS date, label, count(*) AS "count", {_r('avg(conf)', 10)} AS conf FROM posts GROUP BY date, label""",
    "signed_daily": f"""WITH {POSTS},
info AS (SELECT date, replace(label, '"', '') AS label, count(*) AS n, avg(conf) AS conf FROM posts GROUP BY 1, 2),
signed AS (SELECT *, CASE WHEN label = 'POSITIVE' THEN conf ELSE -conf END + 0e0 AS s FROM info)
SELECT {_day('date')} AS date, label, n AS "count", {_r('conf', 10)} AS conf, {_r('s', 10)} AS signed_score,
       CASE WHEN s = 0 THEN 'NEUTRAL' WHEN s > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS score_label FROM signed""",
    "daily_sentiment": f"WITH {DAILY} SELECT {_DAILY_COLUMNS} FROM daily",
    "daily_sentiment_all_days": f"WITH {_daily(all_days=True, ranged=False)} SELECT {_DAILY_COLUMNS} FROM daily",
    "daily_sentiment_uneven_media": f"WITH {UNEVEN} SELECT medium, {_DAILY_COLUMNS} FROM daily",
    "uneven_media_prices": f"""WITH {UNEVEN},
cut AS (SELECT medium, m.date, high, low, (high + low) / 2 AS mid FROM market m JOIN bounds ON m.date BETWEEN lo AND hi)
SELECT medium, {_day('date')} AS date, {_r('high')} AS high, {_r('low')} AS low, {_r('mid')} AS mid_price,
  {_r('(mid - min(mid) OVER w) / nullif(max(mid) OVER w - min(mid) OVER w, 0)')} AS norm_mid_price
FROM cut WINDOW w AS (PARTITION BY medium)""",
    "daily_sentiment_by_medium": f"WITH {BY_MEDIUM} SELECT medium, {_DAILY_COLUMNS} FROM daily",
    "daily_without_outliers": f"WITH {_daily(limit=OUTLIER_LIMIT)} SELECT {_DAILY_COLUMNS} FROM daily",
    "daily_without_period": f"""WITH {POSTS}
SELECT {_day('date')} AS date, replace(label, '"', '') AS label, count(*) AS "count", {_r('avg(conf)', 10)} AS conf
FROM posts WHERE date < DATE '1998-11-01' OR date > DATE '1998-11-30' GROUP BY date, 2""",
    "market_daily": f"""WITH {MARKET}
SELECT {_day('date')} AS date, {_r('high')} AS high, {_r('low')} AS low FROM market""",
    "market_daily_by_pair": f"""WITH m AS (
  SELECT o_orderpriority AS pair, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS high, min(o_totalprice) AS low
  FROM orders GROUP BY 1, 2), p AS (SELECT *, (high + low) / 2 AS mid FROM m)
SELECT pair, {_day('date')} AS date, {_r('high')} AS high, {_r('low')} AS low, {_r('mid')} AS mid_price,
       {_r('(mid - min(mid) OVER (PARTITION BY pair)) / (max(mid) OVER (PARTITION BY pair) - min(mid) OVER (PARTITION BY pair))')}
         AS norm_mid_price FROM p""",
    "market_prices": f"""WITH {_BASE}
SELECT {_day('date')} AS date, {_r('high')} AS high, {_r('low')} AS low, {_r('mid_price')} AS mid_price,
       {_r('norm_mid_price')} AS norm_mid_price FROM prices""",
    "common_date_range": f"WITH {DAILY} SELECT {_day('lo')} AS lo, {_day('hi')} AS hi FROM bounds",
    "common_dates": f"""WITH {DAILY}
SELECT {_day('date')} AS date FROM (SELECT date FROM info UNION SELECT date FROM market)
WHERE date BETWEEN (SELECT lo FROM bounds) AND (SELECT hi FROM bounds)""",
    "normalized_volume": f"""WITH {DAILY}
SELECT {_day('date')} AS date, n AS "count",
       {_r('(n - min(n) OVER ()) / CAST(max(n) OVER () - min(n) OVER () AS DOUBLE)')} AS scaled,
       {_r('n / CAST(max(n) OVER () AS DOUBLE)')} AS scaled_from_zero FROM daily""",
    "first_post_of_day": f"""WITH {POSTS}
SELECT {_day('date')} AS date, label, {_r('conf')} AS conf, medium
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY label, conf, medium) AS place FROM posts) WHERE place = 1""",
    "monthly_mean_volume": f"WITH {DAILY} {_monthly(())}",
    "monthly_volume_by_medium": f"WITH {BY_MEDIUM} {_monthly(('medium',))}",
    "sentiment_histogram": f"WITH {DAILY}, {ROUNDED} SELECT v AS norm_sent, count(*) AS rows FROM rounded GROUP BY v",
    "volume_histogram": f'WITH {DAILY} SELECT n AS "count", count(*) AS rows FROM daily GROUP BY n',
    "clipped_volume_histogram": f"""WITH {DAILY}
SELECT n AS "count", count(*) AS rows FROM daily WHERE n <= (SELECT quantile_cont(n, 0.75) FROM daily) GROUP BY n""",
    "sentiment_box": f"WITH {DAILY}, {ROUNDED}, {_box('rounded', 'v')}",
    "volume_box": f"WITH {DAILY}, {_box('daily', 'n')}",
    "volume_box_by_medium": f"WITH {BY_MEDIUM}, {_box('daily', 'n', 'medium')}",
    "volume_outliers": f"""WITH {DAILY}, q AS (
  SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM daily)
SELECT {_day('date')} AS date, n AS "count" FROM daily, q
WHERE n < q1 - 1.5 * (q3 - q1) OR n > q3 + 1.5 * (q3 - q1)""",
    "price_quantiles": f"""SELECT CAST(prob AS DOUBLE) AS prob, {_r('quantile', 4)} AS quantile FROM (
  SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS prob,
         unnest(quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.75, 0.95])) AS quantile FROM orders)""",
    "price_quantiles_by_pair": f"""SELECT pair, CAST(prob AS DOUBLE) AS prob, {_r('quantile', 4)} AS quantile FROM (
  SELECT o_orderpriority AS pair, unnest([0.25, 0.5, 0.75]) AS prob,
         unnest(quantile_cont(o_totalprice, [0.25, 0.5, 0.75])) AS quantile FROM orders GROUP BY 1)""",
    "sentiment_time_bins": f"WITH {DAILY}, {_bins('daily', 'norm_sent')}".replace("TOTAL", _BIN_DOUBLE),
    "volume_time_bins": f"WITH {DAILY}, {_bins('daily', 'n')}".replace("TOTAL", _BIN_LONG),
    "volume_time_bins_selected": f"WITH {BY_MEDIUM}, {_bins('daily', 'n', 'medium', ('1997-01-01', '1998-12-31'))}".replace(
        "TOTAL", _BIN_LONG
    ),
    "volume_trend": _trend(DAILY, "daily", "n", 5),
    "price_trend": _trend(_BASE, "prices", "mid_price", 2),
    "volume_line_by_medium": f"""WITH {BY_MEDIUM},
t AS (SELECT *, date - DATE '1970-01-01' AS x FROM daily),
line AS (SELECT medium, regr_slope(n, x) AS slope, regr_intercept(n, x) AS base FROM t GROUP BY 1)
SELECT medium, {_day('date')} AS date, n AS "count", {_r('base + slope * x', 6)} AS trend FROM t JOIN line USING (medium)""",
    "sentiment_vs_price": f"""WITH {_BASE}, {_SENT}
SELECT {_day('date')} AS date, i, {_r('x')} AS norm_sent, {_r('y')} AS mid_price FROM series""",
    "volume_vs_price": f"""WITH {_BASE}, {_VOL}
SELECT {_day('date')} AS date, i, CAST(x AS BIGINT) AS "count", {_r('y')} AS mid_price FROM series""",
    "tlcc_pearson": _tlcc(_BASE, _SENT, TLCC_OFFSETS, ["pearson"]),
    "tlcc_spearman": _tlcc(_BASE, _SENT, TLCC_OFFSETS, ["spearman"]),
    "tlcc_kendall": _kendall(_BASE, _SENT),
    "tlcc_volume": _tlcc(_BASE, _VOL, TLCC_OFFSETS, _BOTH),
    "tlcc_volume_kendall": _kendall(_BASE, _VOL),
    "tlcc_by_medium": _tlcc(_BASE_M, _series("norm_sent", ("medium",)), TLCC_OFFSETS, _BOTH, ("medium",)),
    "tlcc_by_pair": _tlcc(
        f"{DAILY}, {PAIR_PRICES}", _series("norm_sent", ("pair",), prices="pair_prices"), TLCC_OFFSETS, _BOTH, ("pair",)
    ),
    "tlcc_extremes": _extremes(_BASE, _SENT),
    "tlcc_volume_extremes": _extremes(_BASE, _VOL),
    "wtlcc_sentiment": _tlcc(_BASE, _SENT, WINDOW_OFFSETS, ["spearman"], sizes=[QUARTER]),
    "wtlcc_volume": _tlcc(_BASE, _VOL, WINDOW_OFFSETS, ["spearman"], sizes=[QUARTER]),
    "wtlcc_volume_short": _tlcc(_BASE, _VOL, SHORT_OFFSETS, ["spearman"], sizes=[60]),
    "wtlcc_window_sizes": _tlcc(_BASE, _SENT, WINDOW_OFFSETS, ["spearman"], sizes=WINDOW_SIZES),
    "wtlcc_every_size": _tlcc(_BASE, _SENT, WINDOW_OFFSETS, ["spearman"], sizes=EVERY_SIZE),
    "wtlcc_by_medium": _tlcc(
        _BASE_M, _series("norm_sent", ("medium",)), WINDOW_OFFSETS, ["spearman"], ("medium",), [60]
    ),
    "media_summary": f"""WITH {SUMMARY}
SELECT {_day('date')} AS date, {', '.join(
    f"{_r(m + '_sentiment')} AS {m}_sentiment, {_r(m + '_normalized_count')} AS {m}_normalized_count, {m}_count" for m in MEDIA)},
       {_r('sentiment')} AS sentiment, {_r('norm_sent')} AS norm_sent,
       CASE WHEN sentiment > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label, n AS "count" FROM summary""",
    "media_prices": f"""WITH {SUMMARY}
SELECT {_day('date')} AS date, {_r('high')} AS high, {_r('low')} AS low, {_r('mid_price')} AS mid_price,
       {_r('norm_mid_price')} AS norm_mid_price FROM media_prices""",
    "media_monthly_volume": f"""WITH {ALL_MEDIA},
months AS (SELECT strftime(date, '%Y-%m') AS month, medium, avg(n) AS v FROM daily GROUP BY 1, 2)
SELECT month, medium, {_r('v')} AS "count" FROM months
WHERE month IN (SELECT month FROM months GROUP BY 1 HAVING count(*) = 4)""",
    "media_sentiment_long": f"WITH {SUMMARY} {_media_long('sentiment', _r('{m}_sentiment'), 'sentiment')}",
    "media_volume_long": f"""WITH {SUMMARY} {_media_long('count', '{m}_count', '"count"')}""",
    "media_heatmap": f"""WITH {SUMMARY}, long AS ({_media_long('sentiment', '{m}_sentiment', 'sentiment')})
SELECT substr(date, 1, 7) || '-01' AS month, medium, {_r('avg(sentiment)')} AS sentiment FROM long GROUP BY 1, 2""",
    "media_volume_bins": f"""WITH {SUMMARY}, long AS (
  SELECT CAST(date AS DATE) AS date, medium, n FROM ({_media_long('count', '{m}_count', 'n')})),
{_bins('long', 'n', 'medium')}""".replace("TOTAL", _BIN_LONG),
    "media_tlcc": _tlcc(SUMMARY, _MEDIA_SENT, TLCC_OFFSETS, _BOTH),
    "media_tlcc_volume": _tlcc(SUMMARY, _MEDIA_VOL, TLCC_OFFSETS, _BOTH),
    "media_wtlcc": _tlcc(SUMMARY, _MEDIA_SENT, WINDOW_OFFSETS, ["spearman"], sizes=[QUARTER]),
    "media_kendall": _kendall(SUMMARY, _MEDIA_SENT),
    "media_wtlcc_volume": _tlcc(SUMMARY, _MEDIA_VOL, WINDOW_OFFSETS, ["spearman"], sizes=[QUARTER]),
    "media_kendall_volume": _kendall(SUMMARY, _MEDIA_VOL),
    "media_extremes": _extremes(SUMMARY, _MEDIA_SENT),
    "media_volume_extremes": _extremes(SUMMARY, _MEDIA_VOL),
    "media_sentiment_box": f"""WITH {SUMMARY}, long AS (SELECT medium, sentiment FROM ({_media_long('sentiment', '{m}_sentiment', 'sentiment')})),
{_box('long', 'sentiment', 'medium')}""",
    "media_sentiment_histogram": f"""WITH {SUMMARY}, long AS ({_media_long('sentiment', '{m}_sentiment', 'v')}),
nanos AS (SELECT medium, CAST(round(v * 1e9) AS BIGINT) AS signed, abs(CAST(round(v * 1e9) AS BIGINT)) AS nano FROM long),
cut AS (SELECT medium, sign(signed) * {_TWO_DIGITS} + 0e0 AS sentiment FROM nanos)
SELECT medium, sentiment, count(*) AS rows FROM cut GROUP BY 1, 2""",
    "media_sentiment_bins": f"""WITH {SUMMARY}, long AS (
  SELECT CAST(date AS DATE) AS date, medium, v FROM ({_media_long('sentiment', '{m}_sentiment', 'v')})),
{_bins('long', 'v', 'medium')}""".replace("TOTAL", _BIN_DOUBLE),
    "user_retweets": f"WITH {USER_POSTS} SELECT username, full_name, retweets FROM users",
    "user_tweets": f"WITH {USER_POSTS} SELECT username, full_name, tweets FROM users",
    "top_users": f"""WITH {USER_POSTS} SELECT username, full_name, retweets FROM users
ORDER BY retweets DESC NULLS LAST, username NULLS FIRST LIMIT 20""",
    "user_words": f"WITH {USER_POSTS} SELECT username, full_name, {_r('words_avg')} AS words_avg FROM users",
    "user_metrics": f"""WITH {USER_POSTS}
SELECT username, full_name, tweets, retweets, {_r('words_avg')} AS words_avg FROM users""",
    "user_metrics_joined": f"""WITH {USER_POSTS}
SELECT a.username, a.full_name, a.tweets, b.retweets, {_r('c.words_avg')} AS words_avg
FROM users a JOIN users b ON a.username IS NOT DISTINCT FROM b.username AND a.full_name IS NOT DISTINCT FROM b.full_name
JOIN users c ON a.username IS NOT DISTINCT FROM c.username AND a.full_name IS NOT DISTINCT FROM c.full_name""",
    "user_short_texts": f"""WITH {USER_POSTS}, named AS (SELECT * FROM users WHERE username IS NOT NULL)
SELECT username, full_name, tweets, retweets, {_r('words_avg')} AS words_avg FROM named
WHERE words_avg <= 1.1e0 * (SELECT quantile_cont(words_avg, 0.75) FROM named)""",
    "user_plot_area": f"""WITH {USER_POSTS}
SELECT username, full_name, tweets, retweets, {_r('words_avg')} AS words_avg FROM users
WHERE username IS NOT NULL AND tweets BETWEEN 0 AND 40 AND retweets BETWEEN 0 AND 1000""",
    "user_metric_boxes": f"""WITH {USER_POSTS}, long AS (
  SELECT 'tweets' AS metric, tweets AS value FROM users WHERE username IS NOT NULL
  UNION ALL SELECT 'retweets', retweets FROM users WHERE username IS NOT NULL
  UNION ALL SELECT 'words_avg', CAST(trunc(words_avg) AS BIGINT) FROM users),
{_box('long', 'value', 'metric')}""",
    "user_words_long": f"""WITH {USER_POSTS}
SELECT viz, CAST(trunc(words_avg) AS INTEGER) AS words_avg FROM users CROSS JOIN (SELECT unnest(['outliers', 'no outliers']) AS viz)""",
    "format_datetimes": f"""WITH {RAW_TIMES}, read AS (
  SELECT event_id, CASE kind WHEN 0 THEN ts WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) END AS t FROM raw)
SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS datetime, {_day('t')} AS date, t IS NOT NULL AS formatted FROM read""",
    "datetime_rejects": f"""WITH {RAW_TIMES} SELECT event_id, 'n/a ' || event_id AS datetime FROM raw WHERE kind = 3""",
    "format_pending_datetimes": f"""WITH {RAW_TIMES}, read AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END
    WHEN kind = 0 THEN ts WHEN kind = 1 THEN date_trunc('minute', ts) WHEN kind = 2 THEN date_trunc('day', ts) END AS t FROM raw)
SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS datetime, {_day('t')} AS date, t IS NOT NULL AS formatted FROM read""",
    "format_free_datetimes": f"""WITH read AS (
  SELECT event_id, date_trunc(CASE WHEN event_id % 8 IN (0, 3, 4, 6) THEN 'second' WHEN event_id % 8 IN (1, 2) THEN 'minute' ELSE 'day' END, ts) AS t
  FROM events)
SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS datetime, {_day('t')} AS date, true AS formatted FROM read""",
    "datetime_format_check": f"""WITH {RAW_TIMES} SELECT event_id % 5 = 0 AS standard, count(*) AS rows FROM raw GROUP BY 1""",
    "word_counts": """SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN -1
  ELSE len(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\v]+')) END AS INTEGER) AS words FROM documents""",
    "clean_html": f"SELECT page_id, {_cleaned('html')} AS text FROM pages",
    "parsed_texts": f"SELECT doc_id, {_TRIMMED} AS text FROM documents",
    "page_articles": f"SELECT page_id, url, {_TITLE_SQL} AS title, {_TEXT_SQL} AS text FROM pages",
    "country_names": """SELECT c_custkey, 'n' || c_nationkey AS country_code,
  CASE WHEN c_custkey % 10 = 0 THEN 'already named' ELSE n_name END AS country_name,
  CASE WHEN c_custkey % 10 = 0 THEN '000' ELSE lpad(CAST(n_nationkey AS VARCHAR), 3, '0') END AS country_id
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey""",
    "pending_countries": """WITH c AS (
  SELECT c_custkey % 10 = 0 AS named, c_nationkey % 5 <> 0 AND n_nationkey IS NOT NULL AS known
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT count(*) AS total, count(*) FILTER (NOT named) AS pending, count(*) FILTER (named) AS done, 'before' AS stage FROM c
UNION ALL
SELECT count(*), count(*) FILTER (NOT (named OR known)), count(*) FILTER (named OR known), 'after' FROM c""",
    "numeric_ids": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS id FROM events",
    "merge_upsert_text": f"""WITH d AS (
  SELECT {_TRIMMED} AS text, doc_id, doc_id % 2 AS rank, CASE WHEN doc_id % 2 = 1 THEN lang END AS lang,
         CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS source, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_chars
  FROM documents)
SELECT text, arg_min(doc_id, (rank, doc_id)) AS doc_id, arg_min(lang, (rank, doc_id)) FILTER (lang IS NOT NULL) AS lang,
       coalesce(arg_min(source, (rank, doc_id)) FILTER (source <> ''), '') AS source,
       arg_min(n_chars, (rank, doc_id)) FILTER (n_chars IS NOT NULL) AS n_chars
FROM d GROUP BY text""",
    "merge_upsert_id": """WITH gaps AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN lang END AS lang, source, n_chars FROM documents WHERE doc_id % 3 <> 0),
fill AS (SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0),
rest AS (SELECT doc_id, upper(lang) AS lang, source, n_chars + 1 AS n_chars FROM documents)
SELECT doc_id, coalesce(gaps.lang, fill.lang, rest.lang) AS lang, coalesce(gaps.source, rest.source) AS source,
       coalesce(gaps.n_chars, rest.n_chars) AS n_chars
FROM rest LEFT JOIN gaps USING (doc_id) LEFT JOIN fill USING (doc_id)""",
    "merge_messages": f"""WITH d AS (SELECT {_TRIMMED} AS text, conv_id, turn, role FROM conversations)
SELECT text, arg_min(conv_id, (conv_id, turn)) AS conv_id, arg_min(turn, (conv_id, turn)) AS turn,
       arg_min(role, (conv_id, turn)) AS role FROM d GROUP BY text""",
    "merge_none_text": f"""WITH d AS (
  SELECT CASE doc_id % 10 WHEN 0 THEN 'None' WHEN 1 THEN NULL ELSE {_TRIMMED} END AS text, doc_id, replace(lang, '"', '') AS lang,
         CASE WHEN doc_id % 4 <> 0 THEN source END AS source FROM documents)
SELECT text, arg_min(lang, doc_id) FILTER (lang IS NOT NULL) AS lang, arg_min(source, doc_id) FILTER (source IS NOT NULL) AS source
FROM d WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT text, lang, source FROM d WHERE text IS NULL""",
    "merge_report": f"""WITH d AS (SELECT {_TRIMMED} AS text, doc_id, doc_id % 2 AS rank FROM documents),
k AS (SELECT text, min(rank) AS opener, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b FROM d GROUP BY 1)
SELECT 0 AS source, count(*) FILTER (opener = 0) AS inserted, CAST(sum(a) AS BIGINT) - count(*) FILTER (opener = 0) AS updated FROM k
UNION ALL
SELECT 1, count(*) FILTER (opener = 1), CAST(sum(b) AS BIGINT) - count(*) FILTER (opener = 1) FROM k""",
    "align_columns": f"""WITH {MESSAGES}
SELECT event_id AS id, user_id, CAST(NULL AS VARCHAR) AS username, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, props AS text,
       CAST(NULL AS BIGINT) AS retweets, CAST(NULL AS DOUBLE) AS conf FROM messages""",
    "schema_columns": "\nUNION ALL ".join(
        f"""SELECT {place} AS position, '{c}' AS name, CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type, count({c}) AS filled FROM lineitem"""
        for place, c in enumerate(LINEITEM_COLUMNS)
    ),
    "sentences": f"WITH {_sentences('documents', 'doc_id')} SELECT * FROM sent",
    "sentence_scores": f"""WITH {_sentences('documents', 'doc_id')}, {_SCORED}
SELECT doc_id, pos, label, {_r('conf')} AS conf FROM scored""",
    "classify_lexicon": _classified(_SCORED),
    "classify_lexicon_table": _classified(_SCORED),
    "classify_model": _classified(_MODEL),
    "classify_pending": f"""WITH {_sentences('documents', 'doc_id')}, {_SCORED}, {_verdicts('doc_id')},
known AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS old, CASE WHEN toxic = 0 THEN 0.5e0 END AS kept FROM labels)
SELECT doc_id, CASE WHEN kept IS NOT NULL OR text = '' THEN old ELSE coalesce(label, 'NEUTRAL') END AS label,
       {_r("CASE WHEN kept IS NOT NULL OR text = '' THEN kept ELSE coalesce(conf, 0e0) END")} AS conf
FROM documents LEFT JOIN verdicts USING (doc_id) LEFT JOIN known USING (doc_id)""",
    "classified_posts_per_label": f"""WITH turns AS (SELECT *, conv_id * 1000 + turn AS key FROM conversations),
{_sentences('turns', 'key')}, {_SCORED}, {_verdicts('key')},
done AS (SELECT role, coalesce(label, 'NEUTRAL') AS label, coalesce(conf, 0e0) AS conf FROM turns LEFT JOIN verdicts USING (key))
SELECT role, label, count(*) AS "count", {_r('avg(conf)')} AS conf FROM done GROUP BY 1, 2""",
    "csv_export_and_read": f"""WITH {POSTS}
SELECT {_day('date')} AS date, label, count(*) AS "count", {_r('avg(conf)', 10)} AS conf FROM posts GROUP BY date, label""",
    "csv_malformed_lines": """SELECT 'x' || o_orderkey || ',' || o_orderpriority || ',' || o_totalprice AS line FROM orders WHERE o_orderkey % 5 = 0""",
    "csv_texts_with_line_breaks": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "csv_columns_by_header": """SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 2 = 1 THEN c_nationkey END AS c_nationkey FROM customer""",
    "csv_drops_malformed": f"SELECT o_orderpriority AS priority, {_r('o_totalprice')} AS price FROM orders WHERE o_orderkey % 5 <> 0",
    "headerless_articles": f"""SELECT nullif({_TITLE_SQL}, '') AS title, media, url AS link, {_TEXT_SQL} AS text
FROM pages CROSS JOIN (SELECT unnest([NULL, 'second run']) AS media)""",
    "found_files": """SELECT o_orderkey AS orderkey, o_orderpriority AS priority FROM orders
WHERE year(o_orderdate) IN (1996, 1997)""",
    "json_messages": f"""WITH {MESSAGES}
SELECT event_id AS message_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS datetime, {_day('ts')} AS date,
       props AS text, user_id, views, forwards FROM messages""",
    "json_message_arrays": f"""WITH {MESSAGES}
SELECT event_id AS message_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS datetime, {_day('ts')} AS date,
       props AS text, user_id, views, forwards FROM messages""",
    "json_rejects": "SELECT '{broken ' || event_id AS line FROM events WHERE event_id % 50 = 0",
    "json_messages_beside_rejects": f"""WITH {MESSAGES}
SELECT event_id AS message_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS datetime, {_day('ts')} AS date,
       props AS text, user_id, views, forwards FROM messages WHERE event_id % 50 <> 0""",
    "messages_incomplete": """SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS date FROM events
WHERE event_type <> 'error' AND (event_id % 9 = 0 OR event_id % 13 = 0 OR props IS NULL OR (event_id % 5 <> 0 AND user_id IS NULL))""",
    "table_version": """SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\v]+')) AS INTEGER) AS words FROM documents""",
    "json_chart_data": f"WITH {DAILY} {_monthly(())}",
    "csv_mixed_headers": """SELECT CASE WHEN c_custkey % 3 < 2 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS c_name,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 1 THEN c_nationkey END AS c_nationkey
FROM customer""",
    "written_back": """SELECT doc_id, lang, source, CAST(CASE WHEN source IN ('src1', 'src12') AND doc_id % 3 > 0
  THEN len(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\v]+')) ELSE -1 END AS INTEGER) AS words FROM documents""",
    "repeated_batches": f"""WITH {MESSAGES}
SELECT event_id AS message_id, user_id, views, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS batch FROM messages""",
    "appended_rows": f"WITH {MESSAGES} SELECT event_id AS message_id, user_id, views FROM messages",
}
ORACLES["master_merge_text"] = ORACLES["merge_upsert_text"]
ORACLES["master_merge_id"] = ORACLES["merge_upsert_id"]
ORACLES["master_merge_counts"] = f"""WITH d AS (SELECT {_TRIMMED} AS text, doc_id % 2 AS rank, doc_id % 7 = 0 AS lone FROM documents),
k AS (SELECT text, min(rank) AS opener, max(rank) AS last FROM d WHERE NOT lone GROUP BY 1),
m AS (SELECT unnest([0, 1]) AS merge)
SELECT CAST(merge AS INTEGER) AS merge, (SELECT count(*) FROM k WHERE opener = merge) AS inserted,
  (SELECT count(*) FROM k WHERE opener < merge AND last = merge) AS updated, (SELECT count(*) FROM d WHERE lone AND rank = merge) AS keyless
FROM m"""

_BLOCKS = f"""
marked AS (
  SELECT page_id, url, html, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
    translate(regexp_replace(regexp_replace(html, '(?is)<title[^>]*>(.*?)</title>', '', 'g'), '{_DROPPED}', '', 'g'), chr(28) || chr(29) || chr(30), ''),
    '(?i)<a\\b[^>]*>', chr(28), 'g'), '(?i)</a\\s*>', chr(29), 'g'), '{_BREAK}', chr(30), 'g'), chr(30)),
    lambda s: {{'text': {_tidy("translate(regexp_replace(s, '(?s)<[^>]*>', '', 'g'), chr(28) || chr(29), '')")},
      'linked': {_tidy("array_to_string(regexp_extract_all(regexp_replace(s, '(?s)<[^>]*>', '', 'g'), chr(28) || '([^' || chr(29) || ']*)', 1), ' ')")}}}),
    lambda b: b.text <> '') AS blocks FROM pages),
counted AS (
  SELECT page_id, url, html, list_transform(blocks, lambda b: {{'text': b.text, 'words': len(string_split(b.text, ' ')),
    'linked': CASE WHEN b.linked = '' THEN 0 ELSE len(string_split(b.linked, ' ')) END}}) AS b FROM marked),
near AS (
  SELECT page_id, k, b[k].text AS text, b[k].words AS words, b[k].linked / b[k].words AS share,
    CASE WHEN k > 1 THEN b[k - 1].words ELSE 0 END AS before, CASE WHEN k > 1 THEN b[k - 1].linked / b[k - 1].words ELSE 0 END AS share_before,
    CASE WHEN k < len(b) THEN b[k + 1].words ELSE 0 END AS after
  FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS k FROM counted)),
bodies AS (
  SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text FROM near
  WHERE share <= 1 / 3 AND CASE WHEN share_before <= 5 / 9 THEN words > 16 OR after > 15 OR before > 4 ELSE words > 40 OR after > 17 END
  GROUP BY page_id)"""
ORACLES["page_bodies"] = f"""WITH {_BLOCKS}
SELECT page_id, url, {_TITLE_SQL} AS title, coalesce(bodies.text, '') AS text FROM pages LEFT JOIN bodies USING (page_id)"""

ORACLES["source_day_orders"] = """SELECT event_type, count(*) FILTER (day_first AND day(ts) > 12) AS day_votes,
  count(*) FILTER (NOT day_first AND day(ts) > 12) AS month_votes, count(*) FILTER (day_first AND day(ts) > 12) > count(*) FILTER (NOT day_first AND day(ts) > 12) AS day_first
FROM (SELECT *, event_type IN ('view', 'error') AS day_first FROM events) GROUP BY event_type"""
ORACLES["source_datetimes"] = """SELECT event_id, event_type, strftime(moved, '%Y-%m-%d %H:%M:00.000000') AS datetime, strftime(moved, '%Y-%m-%d') AS date, true AS formatted
FROM (SELECT *, ts + to_months(CAST(event_id % 12 AS INTEGER)) AS moved FROM events)"""

_WEIGHTS = """
told AS (SELECT list_distinct(regexp_extract_all(lower(text), '\\p{L}+')) AS words, toxic = 0 AS p FROM documents JOIN labels USING (doc_id)
  WHERE doc_id % 3 <> 1 AND toxic IS NOT NULL),
totals AS (SELECT count(*) FILTER (p) AS all_p, count(*) FILTER (NOT p) AS all_n FROM told),
word_counts AS (SELECT word, count(*) FILTER (p) AS p, count(*) FILTER (NOT p) AS n FROM (SELECT unnest(words) AS word, p FROM told) GROUP BY word),
cells AS (SELECT word, p + 0.5e0 AS a, all_p - p + 0.5e0 AS b, n + 0.5e0 AS c, all_n - n + 0.5e0 AS d FROM word_counts, totals WHERE all_p > 0 AND all_n > 0),
weights AS (
  SELECT word, round(ln(a) - ln(b) - ln(c) + ln(d), 12) AS weight FROM cells
  WHERE abs(round(ln(a) - ln(b) - ln(c) + ln(d), 12)) >= round(3 * sqrt(1 / a + 1 / b + 1 / c + 1 / d), 12)
  UNION ALL SELECT '', round(ln(all_p + 0.5e0) - ln(all_n + 0.5e0), 12) FROM totals)"""
ORACLES["learned_weights"] = f"WITH {_WEIGHTS} SELECT word, {_r('weight', 6)} AS weight FROM weights"
ORACLES["classify_learned"] = f"""WITH {_sentences('documents', 'doc_id')}, {_WEIGHTS},
spoken AS (SELECT doc_id, pos, unnest(list_append(regexp_extract_all(lower(sentence), '\\p{{L}}+'), '')) AS word FROM sent),
summed AS (SELECT doc_id, pos, round(sum(weight), 9) AS score FROM spoken JOIN weights USING (word) GROUP BY ALL),
scored AS (
  SELECT doc_id, pos, CASE WHEN score > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label, tanh(abs(score) / 2) AS conf FROM summed WHERE score <> 0),
{_verdicts('doc_id')}
SELECT doc_id, CASE WHEN text <> '' THEN coalesce(label, 'NEUTRAL') END AS label,
  {_r("CASE WHEN text <> '' THEN coalesce(conf, 0e0) END", 6)} AS conf
FROM documents LEFT JOIN verdicts USING (doc_id)"""

_ABBREVIATED = """
docs AS (SELECT doc_id, replace(replace(replace(replace(replace(text, ' the ', ' etc. '), ' que ', ' etc. '), ' und ', ' etc. '),
  ' of ', ' e.g. '), ' de ', ' e.g. ') AS text FROM documents),
tokens AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+(?:\\.\\p{L}+)*\\.?')) AS token FROM docs),
stop_counts AS (SELECT regexp_replace(token, '\\.$', '') AS word, count(*) AS n, count(*) FILTER (token LIKE '%.') AS stops FROM tokens GROUP BY 1),
usual AS (SELECT sum(stops) / sum(n)::DOUBLE AS u FROM stop_counts),
abbreviations AS (
  SELECT word, round(2 * (stops * (ln(0.99e0) - ln(u)) + (n - stops) * (ln(0.01e0) - ln(1 - u))) * exp(-len(replace(word, '.', '')))
    * (len(word) - len(replace(word, '.', '')) + 1) * pow(len(replace(word, '.', '')), (stops - n)::DOUBLE), 9) AS score
  FROM stop_counts, usual WHERE stops > 0)"""
ORACLES["abbreviations"] = f"WITH {_ABBREVIATED} SELECT word, {_r('score', 6)} AS score FROM abbreviations WHERE score >= 0.3"
ORACLES["whole_sentences"] = f"""WITH {_ABBREVIATED}, {_sentences('docs', 'doc_id')},
open AS (
  SELECT doc_id, pos, sentence, lag(score IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY pos) AS goes_on
  FROM sent LEFT JOIN (SELECT * FROM abbreviations WHERE score >= 0.3) ON word = lower(regexp_extract(sentence, '(\\p{{L}}+(?:\\.\\p{{L}}+)*)\\.$', 1))),
numbered AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS whole FROM open)
SELECT doc_id, CAST(whole AS INTEGER) AS pos, string_agg(sentence, ' ' ORDER BY pos) AS sentence FROM numbered GROUP BY doc_id, whole"""
