"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code where it matters: the complete-panel
rule here uses a lag over the union calendar (the reference's wide-frame
semantics), while the Spark operator uses an entity-window + per-ts
aggregate.  CTE fragments are composed per query; every query ends in a
SELECT whose column names match the Spark DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

R = 6  # decimals kept on both sides for double columns
NUDGE = 1e-9  # added before rounding on both sides, so that a mean such as 0.0003125 is no tie


@dataclass(frozen=True)
class FeatureParams:
    """Parameters of a feature query, written out here so that the package's own defaults are checked too."""

    vol_windows: tuple[int, ...] = (5, 10, 20)
    vol_norm: str = "zscore"
    proxy_mode: str = "zscore"
    proxy_window: int = 5
    start: str | None = None
    end: str | None = None
    model_proxy: bool = True

    @property
    def feature_columns(self) -> list[str]:
        return ["normalized_returns", *(f"vol_{w}" for w in self.vol_windows), "market_vola"]


#: Observations of each panel (entity, raw_ts, value) and its period.
PANELS = {
    "flag_week": ("SELECT l_returnflag AS entity, l_shipdate AS raw_ts, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem", "week"),
    "flag_day": ("SELECT l_returnflag AS entity, l_shipdate AS raw_ts, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem", "day"),
    "event_hour": ("SELECT event_type AS entity, ts AS raw_ts, CAST(value AS DOUBLE) AS value FROM events", "hour"),
    "priority_week": ("SELECT o_orderpriority AS entity, o_orderdate AS raw_ts, CAST(o_totalprice AS DOUBLE) AS value FROM orders", "week"),
}
PROXY = "^MKT"


def rnd(expr: str, alias: str, digits: int = R) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE!r}, {digits}) AS {alias}"


def panel_ctes(spec: tuple[str, str]) -> list[tuple[str, str]]:
    src, period = spec
    bucket = f"CAST(date_trunc('{period}', raw_ts) AS TIMESTAMP)"
    mean = "avg(value)"
    return [
        ("obs", f"SELECT * FROM ({src}) WHERE entity IS NOT NULL AND raw_ts IS NOT NULL"),
        (
            "prices",
            f"SELECT entity, {bucket} AS ts, {mean} AS price FROM obs GROUP BY 1, 2 "
            f"UNION ALL SELECT '{PROXY}' AS entity, {bucket} AS ts, {mean} AS price FROM obs GROUP BY 2",
        ),
    ]


def date_filter_cte(params: FeatureParams) -> list[tuple[str, str]]:
    conds = []
    if params.start:
        conds.append(f"ts >= TIMESTAMP '{params.start}'")
    if params.end:
        conds.append(f"ts <= TIMESTAMP '{params.end}'")
    where = (" WHERE " + " AND ".join(conds)) if conds else ""
    return [("fprices", f"SELECT * FROM prices{where}")]


def returns_ctes() -> list[tuple[str, str]]:
    return [
        ("nent", "SELECT count(DISTINCT entity) AS n FROM fprices"),
        ("cal0", "SELECT ts, count(*) FILTER (price > 0) AS n_present FROM fprices GROUP BY ts"),
        (
            "cal",
            "SELECT ts, n_present, n_present = (SELECT n FROM nent) AS complete, "
            "lag(ts) OVER (ORDER BY ts) AS prev_ts, "
            "lag(n_present = (SELECT n FROM nent)) OVER (ORDER BY ts) AS prev_complete FROM cal0",
        ),
        ("kept", "SELECT ts FROM cal WHERE complete AND coalesce(prev_complete, false)"),
        (
            "rets",
            "SELECT entity, ts, CASE WHEN price > 0 AND before > 0 THEN ln(price / before) END AS ret FROM "
            "(SELECT entity, ts, price, lag(price) OVER (PARTITION BY entity ORDER BY ts) AS before FROM fprices)",
        ),
        ("returns", "SELECT entity, ts, ret FROM rets WHERE ts IN (SELECT ts FROM kept)"),
    ]


def _norm(col: str, method: str) -> str:
    part = "OVER (PARTITION BY entity)"
    if method == "zscore":
        return f"({col} - avg({col}) {part}) / nullif(stddev_samp({col}) {part}, 0)"
    if method == "minmax":
        return f"({col} - min({col}) {part}) / nullif(max({col}) {part} - min({col}) {part}, 0)"
    if method == "log":
        return f"ln(1 + {col})"
    return col


def _proxy(mode: str, window: int) -> str:
    base = "(SELECT ts, price FROM fprices WHERE entity = '{p}' AND price IS NOT NULL)"
    if mode == "raw":
        return f"SELECT ts, price AS market_vola FROM {base}"
    if mode == "smoothed":
        w = f"OVER (ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
        return f"SELECT ts, CASE WHEN count(price) {w} = {window} THEN avg(price) {w} END AS market_vola FROM {base}"
    if mode == "returns":
        return (
            "SELECT ts, market_vola FROM (SELECT ts, CASE WHEN price / lag(price) OVER (ORDER BY ts) > 0 "
            f"THEN ln(price / lag(price) OVER (ORDER BY ts)) END AS market_vola FROM {base}) "
            "WHERE market_vola IS NOT NULL"
        )
    return (
        "SELECT ts, (price - avg(price) OVER ()) / nullif(stddev_samp(price) OVER (), 0) AS market_vola "
        f"FROM {base}"
    )


def features_ctes(params: FeatureParams, proxy: str = "^MKT") -> list[tuple[str, str]]:
    vols = []
    for w in params.vol_windows:
        frame = f"OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        vols.append(f"CASE WHEN count(ret) {frame} = {w} THEN stddev_samp(ret) {frame} END AS vol_{w}")
    ent_filter = "" if params.model_proxy else f" WHERE entity <> '{proxy}'"
    f1 = (
        "SELECT entity, ts, ret - avg(ret) OVER (PARTITION BY entity) AS normalized_returns, "
        + ", ".join(vols)
        + f" FROM (SELECT * FROM returns{ent_filter})"
    )
    f2 = (
        "SELECT entity, ts, normalized_returns, "
        + ", ".join(f"{_norm(f'vol_{w}', params.vol_norm)} AS vol_{w}" for w in params.vol_windows)
        + " FROM f1"
    )
    cols = params.feature_columns
    notnull = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in cols)
    feats = (
        "SELECT f2.entity, f2.ts, "
        + ", ".join(f"f2.{c}" for c in cols[:-1])
        + ", p.market_vola FROM f2 LEFT JOIN proxy p ON f2.ts = p.ts"
    )
    return [
        ("f1", f1),
        ("f2", f2),
        ("proxy", _proxy(params.proxy_mode, params.proxy_window).format(p=proxy)),
        ("features", f"SELECT * FROM ({feats}) WHERE {notnull}"),
    ]


MATERIALIZE = {"features", "em", "emx", "vit", "fwd", "bwd", "path", "states", "labeled"}


def with_ctes(ctes: list[tuple[str, str]], final: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "

    def one(name: str, body: str) -> str:
        mat = " MATERIALIZED" if name in MATERIALIZE else ""
        return f"{name} AS{mat} ({body})"

    return head + ",\n".join(one(n, b) for n, b in ctes) + "\n" + final


def feature_pipeline(panel: str, params: FeatureParams = FeatureParams()) -> list[tuple[str, str]]:
    spec = PANELS[panel]
    return panel_ctes(spec) + date_filter_cte(params) + returns_ctes() + features_ctes(params, PROXY)


# ---------------------------------------------------------------- registry

DATE_START, DATE_END = "1996-01-01", "1999-12-31"
MAIN, GAP = "flag_day", "event_hour"
ORACLES: dict[str, str] = {}

_BASE = FeatureParams()


def _pipe(panel: str = MAIN, params: FeatureParams = _BASE) -> list[tuple[str, str]]:
    return feature_pipeline(panel, params)


def _ret_pipe(panel: str = MAIN) -> list[tuple[str, str]]:
    spec = PANELS[panel]
    return panel_ctes(spec) + date_filter_cte(_BASE) + returns_ctes()


ORACLES["price_bars"] = with_ctes(panel_ctes(PANELS[MAIN]), f"SELECT entity, ts, {rnd('price', 'price')} FROM prices")
ORACLES["price_bars_last"] = with_ctes(
    panel_ctes(PANELS["flag_week"])[:1],
    f"SELECT entity, ts, {rnd('max(value)', 'price')} FROM (SELECT entity, raw_ts, value, "
    "CAST(date_trunc('week', raw_ts) AS TIMESTAMP) AS ts, "
    "max(raw_ts) OVER (PARTITION BY entity, date_trunc('week', raw_ts)) AS last_ts FROM obs) "
    "WHERE raw_ts = last_ts GROUP BY 1, 2",
)
ORACLES["lookback_filter"] = with_ctes(
    panel_ctes(PANELS[MAIN]),
    f"SELECT entity, ts, {rnd('price', 'price')} FROM prices "
    "WHERE ts >= (SELECT max(ts) FROM prices) - INTERVAL 2 YEAR",
)
ORACLES["entity_filter"] = with_ctes(
    panel_ctes(PANELS[MAIN]), f"SELECT entity, ts, {rnd('price', 'price')} FROM prices WHERE entity IN ('A', 'R')"
)
ORACLES["date_filter"] = with_ctes(
    panel_ctes(PANELS[MAIN]),
    f"SELECT entity, ts, {rnd('price', 'price')} FROM prices "
    f"WHERE ts >= TIMESTAMP '{DATE_START}' AND ts <= TIMESTAMP '{DATE_END}'",
)
ORACLES["complete_panel"] = with_ctes(
    _ret_pipe(GAP),
    "SELECT ts, CAST(n_present AS BIGINT) AS n_present, complete, prev_ts, "
    "complete AND coalesce(prev_complete, false) AS kept FROM cal",
)
ORACLES["kept_calendar"] = with_ctes(_ret_pipe(GAP), "SELECT ts FROM kept")
ORACLES["entity_universe"] = with_ctes(panel_ctes(PANELS[MAIN]), "SELECT DISTINCT entity FROM prices")
ORACLES["missing_entities"] = with_ctes(
    panel_ctes(PANELS[MAIN]),
    "SELECT entity FROM (VALUES ('A'), ('N'), ('R'), ('X'), ('^MKT')) w(entity) "
    "WHERE entity NOT IN (SELECT entity FROM prices)",
)
ORACLES["sanitize_entity"] = with_ctes(
    panel_ctes(PANELS[MAIN]),
    "SELECT entity, replace(replace(entity, '^', ''), '/', '_') AS safe_name FROM (SELECT DISTINCT entity FROM prices)",
)
ORACLES["log_returns"] = with_ctes(_ret_pipe(MAIN), f"SELECT entity, ts, {rnd('ret', 'ret')} FROM returns")
ORACLES["log_returns_gappy"] = with_ctes(_ret_pipe(GAP), f"SELECT entity, ts, {rnd('ret', 'ret')} FROM returns")
ORACLES["mean_returns"] = with_ctes(_ret_pipe(MAIN), f"SELECT entity, {rnd('avg(ret)', 'mu')} FROM returns GROUP BY entity")
ORACLES["normalized_returns"] = with_ctes(
    _ret_pipe(MAIN),
    f"SELECT entity, ts, {rnd('ret', 'ret')}, "
    f"{rnd('ret - avg(ret) OVER (PARTITION BY entity)', 'normalized_returns')} FROM returns",
)


def _rolling_sql() -> str:
    parts = []
    for w in (5, 10, 20):
        frame = f"OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"CASE WHEN count(ret) {frame} = {w} THEN stddev_samp(ret) {frame} END AS vol_{w}")
    return "SELECT entity, ts, ret, " + ", ".join(parts) + " FROM returns"


ORACLES["rolling_vol"] = with_ctes(
    _ret_pipe(MAIN) + [("rv", _rolling_sql())],
    f"SELECT entity, ts, {rnd('ret', 'ret')}, {rnd('vol_5', 'vol_5')}, {rnd('vol_10', 'vol_10')}, {rnd('vol_20', 'vol_20')} FROM rv",
)
for _m in ("zscore", "minmax", "log", "none"):
    ORACLES[f"vol_norm_{_m}"] = with_ctes(
        _ret_pipe(MAIN) + [("rv", _rolling_sql())],
        "SELECT entity, ts, " + ", ".join(rnd(_norm(f"vol_{w}", _m), f"vol_{w}") for w in (5, 10, 20)) + " FROM rv",
    )
for _m in ("raw", "smoothed", "returns", "zscore"):
    ORACLES[f"proxy_{_m}"] = with_ctes(
        panel_ctes(PANELS[MAIN]) + date_filter_cte(_BASE) + [("px", _proxy(_m, 5).format(p="^MKT"))],
        f"SELECT ts, {rnd('market_vola', 'market_vola')} FROM px",
    )
ORACLES["attach_proxy"] = with_ctes(
    _ret_pipe(MAIN) + [("px", _proxy("zscore", 5).format(p="^MKT"))],
    f"SELECT r.entity, r.ts, {rnd('r.ret - avg(r.ret) OVER (PARTITION BY r.entity)', 'normalized_returns')}, "
    f"{rnd('px.market_vola', 'market_vola')} FROM returns r LEFT JOIN px ON r.ts = px.ts",
)

_FEAT_COLS = ", ".join(rnd(c, c) for c in _BASE.feature_columns)
ORACLES["features"] = with_ctes(_pipe(MAIN), f"SELECT entity, ts, {_FEAT_COLS} FROM features")
ORACLES["features_gappy"] = with_ctes(_pipe(GAP), f"SELECT entity, ts, {_FEAT_COLS} FROM features")
ORACLES["features_dated"] = with_ctes(
    _pipe(MAIN, FeatureParams(start=DATE_START, end=DATE_END, vol_norm="minmax", proxy_mode="smoothed")),
    f"SELECT entity, ts, {_FEAT_COLS} FROM features",
)
ORACLES["features_weekly"] = with_ctes(_pipe("priority_week"), f"SELECT entity, ts, {_FEAT_COLS} FROM features")


# ---------------------------------------------------------------- given-model decode (recursive CTEs)


def D(x: float) -> str:
    """A DOUBLE literal (DuckDB reads bare decimals as DECIMAL)."""
    return f"CAST({x!r} AS DOUBLE)"


# Fixed model of the oracle-checked decode: 2 states on vol_5 (same values as the Spark catalog).
G_PI = (0.5, 0.5)
G_A = ((0.95, 0.05), (0.05, 0.95))
G_MU = (-0.5, 1.0)
G_VAR = (0.5, 2.0)
G_FEATURE = "vol_5"


def given_ctes() -> list[tuple[str, str]]:
    lb = [
        f"-0.5 * (ln(2 * pi()) + ln({D(G_VAR[k])}) + (x - {D(G_MU[k])}) * (x - {D(G_MU[k])}) / {D(G_VAR[k])})"
        for k in range(2)
    ]
    la = [[f"ln({D(G_A[i][j])})" for j in range(2)] for i in range(2)]
    lp = [f"ln({D(G_PI[k])})" for k in range(2)]
    a = [[D(G_A[i][j]) for j in range(2)] for i in range(2)]
    p = [D(G_PI[k]) for k in range(2)]
    return [
        (
            "seq",
            f"SELECT entity, ts, {G_FEATURE} AS x, row_number() OVER (PARTITION BY entity ORDER BY ts) AS t, "
            "count(*) OVER (PARTITION BY entity) AS n FROM features",
        ),
        ("em", f"SELECT entity, ts, t, n, x, {lb[0]} AS lb0, {lb[1]} AS lb1 FROM seq"),
        (
            "vit",
            f"SELECT entity, t, {lp[0]} + lb0 AS d0, {lp[1]} + lb1 AS d1, 0 AS bp0, 0 AS bp1 FROM em WHERE t = 1 "
            "UNION ALL SELECT e.entity, e.t, "
            f"greatest(v.d0 + {la[0][0]}, v.d1 + {la[1][0]}) + e.lb0, "
            f"greatest(v.d0 + {la[0][1]}, v.d1 + {la[1][1]}) + e.lb1, "
            f"CASE WHEN v.d0 + {la[0][0]} >= v.d1 + {la[1][0]} THEN 0 ELSE 1 END, "
            f"CASE WHEN v.d0 + {la[0][1]} >= v.d1 + {la[1][1]} THEN 0 ELSE 1 END "
            "FROM vit v JOIN em e ON e.entity = v.entity AND e.t = v.t + 1",
        ),
        (
            "path",
            "SELECT v.entity, v.t, CASE WHEN v.d0 >= v.d1 THEN 0 ELSE 1 END AS s FROM vit v "
            "JOIN (SELECT DISTINCT entity, n FROM em) l ON v.entity = l.entity AND v.t = l.n "
            "UNION ALL SELECT p.entity, p.t - 1, CASE WHEN p.s = 0 THEN v.bp0 ELSE v.bp1 END "
            "FROM path p JOIN vit v ON v.entity = p.entity AND v.t = p.t WHERE p.t > 1",
        ),
        (
            "states",
            "SELECT e.entity, e.ts, e.t, e.n, e.x, CAST(p.s AS INTEGER) AS raw_state FROM em e "
            "JOIN path p ON e.entity = p.entity AND e.t = p.t",
        ),
        ("rvol", "SELECT entity, raw_state, stddev_pop(x) AS vol FROM states GROUP BY 1, 2"),
        (
            "allst",
            "SELECT e.entity, CAST(v.s AS INTEGER) AS raw_state FROM (SELECT DISTINCT entity FROM em) e "
            "CROSS JOIN (VALUES (0), (1)) v(s)",
        ),
        (
            "rmap",
            "SELECT a.entity, a.raw_state, CAST(row_number() OVER (PARTITION BY a.entity "
            "ORDER BY r.vol ASC NULLS LAST, a.raw_state) - 1 AS INTEGER) AS state, r.vol "
            "FROM allst a LEFT JOIN rvol r ON a.entity = r.entity AND a.raw_state = r.raw_state",
        ),
        (
            "labeled",
            "SELECT f.*, m.state FROM features f LEFT JOIN states s ON f.entity = s.entity AND f.ts = s.ts "
            "LEFT JOIN rmap m ON s.entity = m.entity AND s.raw_state = m.raw_state",
        ),
        (
            "emx",
            "SELECT *, greatest(lb0, lb1) AS m, exp(lb0 - greatest(lb0, lb1)) AS b0, "
            "exp(lb1 - greatest(lb0, lb1)) AS b1 FROM em",
        ),
        (
            "fwd",
            f"SELECT entity, t, {p[0]} * b0 / ({p[0]} * b0 + {p[1]} * b1) AS a0, "
            f"{p[1]} * b1 / ({p[0]} * b0 + {p[1]} * b1) AS a1, {p[0]} * b0 + {p[1]} * b1 AS c, "
            f"ln({p[0]} * b0 + {p[1]} * b1) + m AS lc FROM emx WHERE t = 1 "
            "UNION ALL SELECT entity, t, u0 / (u0 + u1), u1 / (u0 + u1), u0 + u1, lc + ln(u0 + u1) + m FROM ("
            f"SELECT e.entity, e.t, e.m, f.lc, (f.a0 * {a[0][0]} + f.a1 * {a[1][0]}) * e.b0 AS u0, "
            f"(f.a0 * {a[0][1]} + f.a1 * {a[1][1]}) * e.b1 AS u1 "
            "FROM fwd f JOIN emx e ON e.entity = f.entity AND e.t = f.t + 1)",
        ),
        (
            "bwd",
            "SELECT entity, t, CAST(1 AS DOUBLE) AS z0, CAST(1 AS DOUBLE) AS z1 FROM emx WHERE t = n "
            "UNION ALL SELECT w.entity, w.t - 1, "
            f"({a[0][0]} * (e.b0 * w.z0) + {a[0][1]} * (e.b1 * w.z1)) / f.c, "
            f"({a[1][0]} * (e.b0 * w.z0) + {a[1][1]} * (e.b1 * w.z1)) / f.c "
            "FROM bwd w JOIN emx e ON e.entity = w.entity AND e.t = w.t "
            "JOIN fwd f ON f.entity = w.entity AND f.t = w.t WHERE w.t > 1",
        ),
    ]


def _given(final: str, panel: str = MAIN) -> str:
    return with_ctes(_pipe(panel) + given_ctes(), final, recursive=True)


def _unpivot(src: str, keep: str, measures=("vol_5", "vol_10", "vol_20", "market_vola")) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{m}' AS measure, {m} AS value FROM {src}" for m in measures)


ORACLES["train_val_split"] = with_ctes(
    _pipe(MAIN) + given_ctes()[:1],
    "SELECT entity, ts, CAST(t AS INTEGER) AS t, CAST(n AS BIGINT) AS n, "
    "CASE WHEN t <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'validate' END AS split FROM seq",
)
ORACLES["min_length_guard"] = with_ctes(
    _pipe(GAP),
    "SELECT entity, count(*) AS n_rows, CASE WHEN count(*) < 450 THEN 'skipped' ELSE 'ok' END AS status "
    "FROM features GROUP BY entity",
)


def _init_sql() -> str:
    ks, seeds = (2, 3), (0, 1, 7)
    qcols = []
    for k in ks:
        for j in range(k):
            qcols.append(f"quantile_cont(v, {D((j + 0.5) / k)}) AS q{k}_{j}")
    grid = ", ".join(f"({k}, {s}, {j})" for k in ks for s in seeds for j in range(k))
    qpick = "CASE " + " ".join(f"WHEN g.k = {k} AND g.j = {j} THEN s.q{k}_{j}" for k in ks for j in range(k)) + " END"
    perturb = (
        f"({D(0.5)} * sqrt(s.var)) * (CAST((g.seed * 7919 + g.j * 104729 + s.d * 1299709 + g.k * 15485863) % 10007 "
        f"AS DOUBLE) / {D(10007.0)} - {D(0.5)})"
    )
    cols = ", ".join(_BASE.feature_columns)
    return with_ctes(
        _pipe(MAIN)
        + [
            (
                "tr",
                f"SELECT entity, [{cols}] AS x FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS t, "
                "count(*) OVER (PARTITION BY entity) AS n FROM features) WHERE t <= floor(n * CAST(0.8 AS DOUBLE))",
            ),
            ("lng", "SELECT entity, CAST(r.d AS INTEGER) AS d, x[r.d + 1] AS v FROM tr CROSS JOIN range(0, 5) r(d)"),
            ("s", "SELECT entity, d, var_samp(v) AS var, " + ", ".join(qcols) + " FROM lng GROUP BY 1, 2"),
            ("g", f"SELECT * FROM (VALUES {grid}) g(k, seed, j)"),
        ],
        "SELECT s.entity, CAST(g.k AS INTEGER) AS k, CAST(g.seed AS INTEGER) AS seed, CAST(g.j AS INTEGER) AS state, "
        f"s.d, round({qpick} + {perturb} + {NUDGE!r}, 6) AS mean FROM s CROSS JOIN g",
    )


ORACLES["hmm_init"] = _init_sql()
ORACLES["emission_logpdf"] = _given(f"SELECT entity, ts, {rnd('lb0', 'lb_0')}, {rnd('lb1', 'lb_1')} FROM em")
ORACLES["hier_decode_rowwise"] = _given(
    f"SELECT entity, ts, CASE WHEN ln({D(G_PI[0])}) + lb0 >= ln({D(G_PI[1])}) + lb1 THEN 0 ELSE 1 END AS sub_state FROM em"
)
ORACLES["hmm_viterbi"] = _given("SELECT entity, ts, raw_state FROM states")
ORACLES["hmm_score"] = _given("SELECT entity, round(lc, 4) AS loglik, CAST(t AS BIGINT) AS n FROM fwd JOIN (SELECT DISTINCT entity, n FROM em) USING (entity) WHERE t = n")
ORACLES["hmm_posterior"] = _given(
    "SELECT e.entity, e.ts, "
    + rnd("f.a0 * b.z0 / (f.a0 * b.z0 + f.a1 * b.z1)", "post_0")
    + ", "
    + rnd("f.a1 * b.z1 / (f.a0 * b.z0 + f.a1 * b.z1)", "post_1")
    + " FROM em e JOIN fwd f ON e.entity = f.entity AND e.t = f.t JOIN bwd b ON e.entity = b.entity AND e.t = b.t"
)
ORACLES["state_volatility"] = _given(f"SELECT entity, raw_state, {rnd('vol', 'vol')} FROM rvol")
ORACLES["relabel_states"] = _given(f"SELECT entity, raw_state, state, {rnd('vol', 'vol')} FROM rmap")
ORACLES["state_labeled"] = _given(f"SELECT entity, ts, {_FEAT_COLS}, state FROM labeled")
_USAGE = (
    "SELECT a.entity, a.raw_state AS state, CAST(coalesce(c.cnt, 0) AS BIGINT) AS cnt FROM allst a LEFT JOIN "
    "(SELECT entity, {col} AS st, count(*) AS cnt FROM {src} GROUP BY 1, 2) c ON a.entity = c.entity AND a.raw_state = c.st"
)
ORACLES["state_usage"] = _given(
    f"SELECT entity, state, cnt, {rnd('cnt / sum(cnt) OVER (PARTITION BY entity)', 'share')} FROM ("
    + _USAGE.format(col="state", src="labeled")
    + ")"
)
ORACLES["state_entropy"] = _given(
    f"SELECT entity, {rnd('sum(-share * ln(share + 1e-10))', 'entropy')} FROM (SELECT entity, "
    "cnt / sum(cnt) OVER (PARTITION BY entity) AS share FROM (" + _USAGE.format(col="state", src="labeled") + ")) GROUP BY entity"
)
_SCORE = (
    "SELECT u.entity, l.lc AS ll, l.n, u.entropy FROM (SELECT entity, sum(-share * ln(share + 1e-10)) AS entropy FROM ("
    "SELECT entity, cnt / sum(cnt) OVER (PARTITION BY entity) AS share FROM ("
    + _USAGE.format(col="raw_state", src="states")
    + ")) GROUP BY entity) u JOIN (SELECT f.entity, f.lc, e.n FROM fwd f JOIN (SELECT DISTINCT entity, n FROM em) e "
    "ON f.entity = e.entity AND f.t = e.n) l ON u.entity = l.entity"
)
ORACLES["entropy_score"] = _given(
    f"SELECT entity, {rnd('ll / n', 'norm_ll')}, {rnd('entropy', 'entropy')}, "
    f"{rnd('ll / n + CAST(4 AS DOUBLE) * entropy', 'score')} FROM ({_SCORE})"
)
ORACLES["bic"] = _given(f"SELECT entity, round(-2 * ll + 7 * ln(n), 4) AS bic FROM ({_SCORE})")
_PATH = (
    "SELECT g.entity, g.i, g.j, coalesce(c.n, 0) / nullif(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.entity, g.i), 0) AS p FROM "
    "(SELECT a.entity, a.raw_state AS i, b.raw_state AS j FROM (SELECT DISTINCT entity, raw_state FROM states) a "
    "JOIN (SELECT DISTINCT entity, raw_state FROM states) b ON a.entity = b.entity) g LEFT JOIN "
    "(SELECT entity, raw_state AS i, nxt AS j, count(*) AS n FROM (SELECT entity, raw_state, "
    "lead(raw_state) OVER (PARTITION BY entity ORDER BY t) AS nxt FROM states) WHERE nxt IS NOT NULL GROUP BY 1, 2, 3) c "
    "ON g.entity = c.entity AND g.i = c.i AND g.j = c.j"
)
ORACLES["transition_matrix"] = _given(
    f"SELECT entity, 'VS0_' || i AS from_label, 'VS0_' || j AS to_label, {rnd('p', 'prob')} FROM ({_PATH})"
)
ORACLES["expected_steps"] = _given(
    f"SELECT entity, 'VS0_' || i AS state_label, {rnd('1 / (1 - p + CAST(1e-10 AS DOUBLE))', 'expected_steps')} FROM ({_PATH}) WHERE i = j"
)
ORACLES["regime_return_means"] = _given(
    f"SELECT entity, state, {rnd('avg(normalized_returns)', 'mean_return')} FROM labeled GROUP BY 1, 2"
)
ORACLES["feature_means"] = _given(
    f"SELECT entity, measure, state, {rnd('avg(value)', 'mean_value')} FROM ({_unpivot('labeled', 'entity, state')}) "
    "GROUP BY 1, 2, 3"
)
ORACLES["regime_capture"] = _given(
    "SELECT g.entity, g.measure, g.state, round(coalesce(s.share, 0) + 1e-9, 6) AS share FROM ("
    "SELECT DISTINCT a.entity, a.state, b.measure FROM sh a JOIN sh b ON a.entity = b.entity) g "
    "LEFT JOIN sh s ON g.entity = s.entity AND g.measure = s.measure AND g.state = s.state"
).replace(
    "\nSELECT g.entity",
    ",\nthr AS (SELECT *, quantile_cont(value, 0.95) OVER (PARTITION BY entity, measure) AS threshold FROM ("
    + _unpivot("labeled", "entity, state")
    + ")),\nhigh AS (SELECT entity, measure, state, count(*) AS cnt FROM thr WHERE value >= threshold GROUP BY 1, 2, 3),\n"
    "sh AS (SELECT entity, measure, state, cnt / sum(cnt) OVER (PARTITION BY entity, measure) AS share FROM high)"
    "\nSELECT g.entity",
)
ORACLES["state_vol_corr"] = _given(
    f"SELECT entity, measure, {rnd('corr(value, CAST(state AS DOUBLE))', 'corr')} FROM ({_unpivot('labeled', 'entity, state')}) GROUP BY 1, 2"
)
ORACLES["vol_trend_by_state"] = _given(
    f"SELECT entity, measure, state, {rnd('avg(trend)', 'avg_trend')} FROM ("
    "SELECT *, ma - lag(ma) OVER (PARTITION BY entity, measure ORDER BY ts) AS trend FROM ("
    "SELECT *, CASE WHEN count(value) OVER w3 = 3 THEN avg(value) OVER w3 END AS ma FROM ("
    + _unpivot("labeled", "entity, ts, state")
    + ") WINDOW w3 AS (PARTITION BY entity, measure ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))) "
    "GROUP BY 1, 2, 3"
)
_BINS = "CAST(least(coalesce(floor((v - lo) * CAST(50 AS DOUBLE) / nullif(hi - lo, 0)), 0), 49) AS INTEGER)"
ORACLES["returns_histogram"] = with_ctes(
    _pipe(MAIN),
    f"SELECT entity, bin, {rnd('lo + (hi - lo) * bin / CAST(50 AS DOUBLE)', 'bin_lo')}, count(*) AS cnt FROM ("
    f"SELECT entity, lo, hi, {_BINS} AS bin FROM (SELECT entity, normalized_returns AS v, "
    "min(normalized_returns) OVER (PARTITION BY entity) AS lo, max(normalized_returns) OVER (PARTITION BY entity) AS hi "
    "FROM features WHERE normalized_returns IS NOT NULL)) GROUP BY entity, bin, lo, hi",
)
ORACLES["regime_histograms"] = _given(
    f"SELECT entity, measure, state, bin, count(*) AS cnt FROM (SELECT entity, measure, state, {_BINS} AS bin FROM ("
    "SELECT entity, measure, state, value AS v, min(value) OVER (PARTITION BY entity, measure) AS lo, "
    "max(value) OVER (PARTITION BY entity, measure) AS hi FROM ("
    + _unpivot("labeled", "entity, state", ("normalized_returns", "vol_5", "vol_10", "vol_20", "market_vola"))
    + ") WHERE value IS NOT NULL)) GROUP BY 1, 2, 3, 4"
)
ORACLES["anova_returns"] = _given(
    "SELECT entity, CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within, "
    f"{rnd('ssb', 'ssb')}, {rnd('ssw', 'ssw')}, {rnd('(ssb / (k - 1)) / nullif(ssw / (n - k), 0)', 'f_stat')} FROM ("
    "SELECT entity, count(*) AS k, sum(n) AS n, sum(ssw_g) AS ssw, sum(n * (m - grand) * (m - grand)) AS ssb FROM ("
    "SELECT *, sum(s) OVER (PARTITION BY entity) / sum(n) OVER (PARTITION BY entity) AS grand FROM ("
    "SELECT entity, state, count(normalized_returns) AS n, sum(normalized_returns) AS s, avg(normalized_returns) AS m, "
    "var_pop(normalized_returns) * count(normalized_returns) AS ssw_g FROM labeled "
    "WHERE normalized_returns IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2)) GROUP BY entity)"
)
ORACLES["regime_series"] = _given(
    f"SELECT entity, ts, {rnd('normalized_returns', 'normalized_returns')}, state, CAST(state % 10 AS INTEGER) AS color_idx FROM labeled"
)
ORACLES["states_vs_vol"] = _given(
    f"SELECT entity, measure, {rnd('quantile_cont(value, 0.95)', 'threshold')}, min(ts) AS ts_first, max(ts) AS ts_last "
    f"FROM ({_unpivot('labeled', 'entity, ts')}) GROUP BY 1, 2"
)
ORACLES["vol_quantiles"] = with_ctes(
    _pipe(MAIN),
    f"SELECT entity, measure, {rnd('quantile_cont(value, 0.95)', 'threshold')} FROM ({_unpivot('features', 'entity')}) GROUP BY 1, 2",
)
ORACLES["vol_spikes"] = with_ctes(
    _pipe(MAIN),
    f"SELECT entity, ts, measure, {rnd('value', 'value')} FROM (SELECT *, quantile_cont(value, 0.95) OVER "
    f"(PARTITION BY entity, measure) AS thr FROM ({_unpivot('features', 'entity, ts')}) WHERE value IS NOT NULL) "
    "WHERE value > thr",
)


# ---------------------------------------------------------------- remaining inventory

_POST = (
    "SELECT e.entity, e.ts, e.t, e.x, f.a0 * b.z0 / (f.a0 * b.z0 + f.a1 * b.z1) AS g0, "
    "f.a1 * b.z1 / (f.a0 * b.z0 + f.a1 * b.z1) AS g1 "
    "FROM em e JOIN fwd f ON e.entity = f.entity AND e.t = f.t JOIN bwd b ON e.entity = b.entity AND e.t = b.t"
)
ORACLES["available_layers"] = _given(
    "SELECT DISTINCT entity, 'regime_layer0' AS layer FROM em UNION SELECT DISTINCT entity, 'sub_level_state' FROM em"
)
ORACLES["layered_features"] = _given(
    f"SELECT entity, ts, {rnd('x', 'x1_0')}, {rnd('g0', 'x1_1')}, {rnd('g1', 'x1_2')} FROM ({_POST})"
)
ORACLES["sub_partition"] = _given(
    "SELECT entity, raw_state AS top_state, count(*) AS n_rows, count(*) >= 10 AS fit_sub FROM states GROUP BY 1, 2"
)


def _em_step_sql() -> str:
    a = [[D(G_A[i][j]) for j in range(2)] for i in range(2)]
    xi_cols = ", ".join(
        f"p.a{i} * {a[i][j]} * e.b{j} * b.z{j} / f.c AS x{i}{j}" for i in range(2) for j in range(2)
    )
    xi = (
        f"SELECT e.entity, {xi_cols} FROM emx e JOIN fwd p ON p.entity = e.entity AND p.t = e.t - 1 "
        "JOIN bwd b ON b.entity = e.entity AND b.t = e.t JOIN fwd f ON f.entity = e.entity AND f.t = e.t"
    )
    trans = ", ".join(
        rnd(f"sum(x{i}{j}) / (sum(x{i}0) + sum(x{i}1))", f"a_{i}{j}") for i in range(2) for j in range(2)
    )
    return _given(
        "SELECT s.entity, "
        + ", ".join(rnd(f"s.p{i}", f"pi_{i}") for i in range(2))
        + ", "
        + ", ".join(rnd(f"x.a_{i}{j}", f"a_{i}{j}") for i in range(2) for j in range(2))
        + ", "
        + ", ".join(rnd(f"s.mu{i}", f"mu_{i}") for i in range(2))
        + ", "
        + ", ".join(rnd(f"v.var{i}", f"var_{i}") for i in range(2))
        + f" FROM (SELECT entity, sum(g0 * x) / sum(g0) AS mu0, sum(g1 * x) / sum(g1) AS mu1, "
        "max(CASE WHEN t = 1 THEN g0 END) AS p0, max(CASE WHEN t = 1 THEN g1 END) AS p1 "
        f"FROM ({_POST}) GROUP BY entity) s "
        f"JOIN (SELECT entity, {trans.replace(', round', ', round')} FROM ({xi}) GROUP BY entity) x ON s.entity = x.entity "
        "JOIN (SELECT q.entity, sum(q.g0 * (q.x - m.mu0) * (q.x - m.mu0)) / sum(q.g0) AS var0, "
        "sum(q.g1 * (q.x - m.mu1) * (q.x - m.mu1)) / sum(q.g1) AS var1 "
        f"FROM ({_POST}) q JOIN (SELECT entity, sum(g0 * x) / sum(g0) AS mu0, sum(g1 * x) / sum(g1) AS mu1 "
        f"FROM ({_POST}) GROUP BY entity) m ON q.entity = m.entity GROUP BY q.entity) v ON s.entity = v.entity"
    )


ORACLES["hmm_em_step"] = _em_step_sql()

# the chunk-parallel decode must reproduce the one-task decode exactly
ORACLES["hmm_viterbi_chunked"] = ORACLES["hmm_viterbi"]
ORACLES["hmm_posterior_chunked"] = ORACLES["hmm_posterior"]
ORACLES["hmm_score_chunked"] = ORACLES["hmm_score"]


# Layer-1 model of the layered decode (same values as the Spark catalog).
L1_PI = (0.5, 0.5)
L1_A = ((0.9, 0.1), (0.1, 0.9))
L1_MU = ((0.0, 0.8, 0.2), (1.0, 0.2, 0.8))
L1_VAR = ((1.0, 0.1, 0.1), (2.0, 0.1, 0.1))


def layered_decode_sql() -> str:
    xs = ["x0", "x1", "x2"]
    lb = []
    for k in range(2):
        logdet = " + ".join(f"ln({D(v)})" for v in L1_VAR[k])
        quad = " + ".join(f"({x} - {D(m)}) * ({x} - {D(m)}) / {D(v)}" for x, m, v in zip(xs, L1_MU[k], L1_VAR[k]))
        lb.append(f"-0.5 * (3 * ln(2 * pi()) + ({logdet}) + ({quad}))")
    la = [[f"ln({D(L1_A[i][j])})" for j in range(2)] for i in range(2)]
    lp = [f"ln({D(L1_PI[k])})" for k in range(2)]
    extra = [
        (
            "in1",
            "SELECT e.entity, e.ts, e.t, e.n, e.x AS x0, f.a0 * b.z0 / (f.a0 * b.z0 + f.a1 * b.z1) AS x1, "
            "f.a1 * b.z1 / (f.a0 * b.z0 + f.a1 * b.z1) AS x2 FROM em e "
            "JOIN fwd f ON e.entity = f.entity AND e.t = f.t JOIN bwd b ON e.entity = b.entity AND e.t = b.t",
        ),
        ("em1", f"SELECT *, {lb[0]} AS lb0, {lb[1]} AS lb1 FROM in1"),
        (
            "vit1",
            f"SELECT entity, t, {lp[0]} + lb0 AS d0, {lp[1]} + lb1 AS d1, 0 AS bp0, 0 AS bp1 FROM em1 WHERE t = 1 "
            "UNION ALL SELECT e.entity, e.t, "
            f"greatest(v.d0 + {la[0][0]}, v.d1 + {la[1][0]}) + e.lb0, "
            f"greatest(v.d0 + {la[0][1]}, v.d1 + {la[1][1]}) + e.lb1, "
            f"CASE WHEN v.d0 + {la[0][0]} >= v.d1 + {la[1][0]} THEN 0 ELSE 1 END, "
            f"CASE WHEN v.d0 + {la[0][1]} >= v.d1 + {la[1][1]} THEN 0 ELSE 1 END "
            "FROM vit1 v JOIN em1 e ON e.entity = v.entity AND e.t = v.t + 1",
        ),
        (
            "path1",
            "SELECT v.entity, v.t, CASE WHEN v.d0 >= v.d1 THEN 0 ELSE 1 END AS s FROM vit1 v "
            "JOIN (SELECT DISTINCT entity, n FROM em1) l ON v.entity = l.entity AND v.t = l.n "
            "UNION ALL SELECT p.entity, p.t - 1, CASE WHEN p.s = 0 THEN v.bp0 ELSE v.bp1 END "
            "FROM path1 p JOIN vit1 v ON v.entity = p.entity AND v.t = p.t WHERE p.t > 1",
        ),
        (
            "st1",
            "SELECT e.*, CAST(p.s AS INTEGER) AS raw_state FROM em1 e JOIN path1 p ON e.entity = p.entity AND e.t = p.t",
        ),
        (
            "rvol1",
            "SELECT entity, raw_state, stddev_pop(v) AS vol FROM ("
            + " UNION ALL ".join(f"SELECT entity, raw_state, {x} AS v FROM st1" for x in xs)
            + ") GROUP BY 1, 2",
        ),
        (
            "rmap1",
            "SELECT a.entity, a.raw_state, CAST(row_number() OVER (PARTITION BY a.entity "
            "ORDER BY r.vol ASC NULLS LAST, a.raw_state) - 1 AS INTEGER) AS state "
            "FROM allst a LEFT JOIN rvol1 r ON a.entity = r.entity AND a.raw_state = r.raw_state",
        ),
    ]
    final = (
        "SELECT s.entity, s.ts, 'regime_layer0' AS layer, s.raw_state, m.state FROM states s "
        "JOIN rmap m ON s.entity = m.entity AND s.raw_state = m.raw_state "
        "UNION ALL SELECT s.entity, s.ts, 'regime_layer1' AS layer, s.raw_state, m.state FROM st1 s "
        "JOIN rmap1 m ON s.entity = m.entity AND s.raw_state = m.raw_state"
    )
    return with_ctes(_pipe(MAIN) + given_ctes() + extra, final, recursive=True)


MATERIALIZE.update({"in1", "em1", "vit1", "path1", "st1"})
ORACLES["layered_decode"] = layered_decode_sql()


# Sub-model of top state 0 (same values as the Spark catalog).
S0_PI = (0.3, 0.7)
S0_MU = (-0.8, 0.0)
S0_VAR = (0.2, 0.6)


def hierarchical_decode_sql() -> str:
    score = [
        f"ln({D(S0_PI[k])}) + -0.5 * (ln(2 * pi()) + ln({D(S0_VAR[k])}) + (x - {D(S0_MU[k])}) * (x - {D(S0_MU[k])}) / {D(S0_VAR[k])})"
        for k in range(2)
    ]
    sub = f"CASE WHEN raw_state = 0 THEN (CASE WHEN {score[0]} >= {score[1]} THEN 0 ELSE 1 END) END"
    final = (
        "SELECT entity, ts, 'top_level_state' AS layer, raw_state AS state FROM states "
        f"UNION ALL SELECT entity, ts, 'sub_level_state' AS layer, CAST({sub} AS INTEGER) AS state FROM states"
    )
    return _given(final)


ORACLES["hierarchical_decode"] = hierarchical_decode_sql()


# Second candidate (seed 1) of the selection query (same values as the Spark catalog).
B_PI = (0.5, 0.5)
B_A = ((0.9, 0.1), (0.1, 0.9))
B_MU = (-1.0, 0.5)
B_VAR = (0.3, 3.0)


def candidate_ctes(p: str, pi, A, mu, var) -> list[tuple[str, str]]:
    """Viterbi usage entropy, forward log-likelihood and entropy score of one given 2-state model."""
    lb = [f"-0.5 * (ln(2 * pi()) + ln({D(var[k])}) + (x - {D(mu[k])}) * (x - {D(mu[k])}) / {D(var[k])})" for k in range(2)]
    la = [[f"ln({D(A[i][j])})" for j in range(2)] for i in range(2)]
    a = [[D(A[i][j]) for j in range(2)] for i in range(2)]
    q = [D(pi[k]) for k in range(2)]
    return [
        (f"{p}em", f"SELECT entity, t, n, {lb[0]} AS lb0, {lb[1]} AS lb1 FROM seq"),
        (
            f"{p}vit",
            f"SELECT entity, t, ln({q[0]}) + lb0 AS d0, ln({q[1]}) + lb1 AS d1, 0 AS bp0, 0 AS bp1 FROM {p}em WHERE t = 1 "
            "UNION ALL SELECT e.entity, e.t, "
            f"greatest(v.d0 + {la[0][0]}, v.d1 + {la[1][0]}) + e.lb0, greatest(v.d0 + {la[0][1]}, v.d1 + {la[1][1]}) + e.lb1, "
            f"CASE WHEN v.d0 + {la[0][0]} >= v.d1 + {la[1][0]} THEN 0 ELSE 1 END, "
            f"CASE WHEN v.d0 + {la[0][1]} >= v.d1 + {la[1][1]} THEN 0 ELSE 1 END "
            f"FROM {p}vit v JOIN {p}em e ON e.entity = v.entity AND e.t = v.t + 1",
        ),
        (
            f"{p}path",
            f"SELECT v.entity, v.t, CASE WHEN v.d0 >= v.d1 THEN 0 ELSE 1 END AS s FROM {p}vit v "
            f"JOIN (SELECT DISTINCT entity, n FROM {p}em) l ON v.entity = l.entity AND v.t = l.n "
            "UNION ALL SELECT p.entity, p.t - 1, CASE WHEN p.s = 0 THEN v.bp0 ELSE v.bp1 END "
            f"FROM {p}path p JOIN {p}vit v ON v.entity = p.entity AND v.t = p.t WHERE p.t > 1",
        ),
        (
            f"{p}emx",
            f"SELECT *, greatest(lb0, lb1) AS m, exp(lb0 - greatest(lb0, lb1)) AS b0, exp(lb1 - greatest(lb0, lb1)) AS b1 FROM {p}em",
        ),
        (
            f"{p}fwd",
            f"SELECT entity, t, {q[0]} * b0 / ({q[0]} * b0 + {q[1]} * b1) AS a0, {q[1]} * b1 / ({q[0]} * b0 + {q[1]} * b1) AS a1, "
            f"ln({q[0]} * b0 + {q[1]} * b1) + m AS lc FROM {p}emx WHERE t = 1 "
            "UNION ALL SELECT entity, t, u0 / (u0 + u1), u1 / (u0 + u1), lc + ln(u0 + u1) + m FROM ("
            f"SELECT e.entity, e.t, e.m, f.lc, (f.a0 * {a[0][0]} + f.a1 * {a[1][0]}) * e.b0 AS u0, "
            f"(f.a0 * {a[0][1]} + f.a1 * {a[1][1]}) * e.b1 AS u1 FROM {p}fwd f JOIN {p}emx e ON e.entity = f.entity AND e.t = f.t + 1)",
        ),
        (
            f"{p}score",
            "SELECT l.entity, l.lc / l.n + CAST(4 AS DOUBLE) * u.entropy AS score FROM "
            f"(SELECT f.entity, f.lc, e.n FROM {p}fwd f JOIN (SELECT DISTINCT entity, n FROM {p}em) e "
            "ON f.entity = e.entity AND f.t = e.n) l JOIN "
            "(SELECT entity, sum(-share * ln(share + 1e-10)) AS entropy FROM (SELECT entity, cnt / sum(cnt) OVER "
            "(PARTITION BY entity) AS share FROM (SELECT a.entity, coalesce(c.cnt, 0) AS cnt FROM "
            "(SELECT DISTINCT entity FROM seq) a0 CROSS JOIN (VALUES (0), (1)) v(s) "
            "JOIN (SELECT DISTINCT entity FROM seq) a ON a.entity = a0.entity "
            f"LEFT JOIN (SELECT entity, s, count(*) AS cnt FROM {p}path GROUP BY 1, 2) c "
            "ON a.entity = c.entity AND v.s = c.s)) GROUP BY entity) u ON l.entity = u.entity",
        ),
    ]


MATERIALIZE.update({"ca_em", "ca_vit", "ca_path", "ca_fwd", "cb_em", "cb_vit", "cb_path", "cb_fwd"})
ORACLES["select_best_given"] = with_ctes(
    _pipe(MAIN)
    + given_ctes()[:1]
    + candidate_ctes("ca_", G_PI, G_A, G_MU, G_VAR)
    + candidate_ctes("cb_", B_PI, B_A, B_MU, B_VAR),
    "SELECT entity, k, seed, round(score + 1e-9, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity "
    "ORDER BY score DESC, k ASC, seed ASC) AS rn FROM (SELECT entity, 2 AS k, 0 AS seed, score FROM ca_score "
    "UNION ALL SELECT entity, 2 AS k, 1 AS seed, score FROM cb_score)) WHERE rn = 1",
    recursive=True,
)


# ---------------------------------------------------------------- F-test, shuffled split, layers, sinks, failures

ORACLES["train_val_split_shuffled"] = with_ctes(
    _pipe(MAIN) + given_ctes()[:1],
    "SELECT entity, ts, CAST(t AS INTEGER) AS t, CAST(n AS BIGINT) AS n, CASE WHEN row_number() OVER (PARTITION BY entity "
    "ORDER BY md5('13:' || CAST(ts AS VARCHAR)), ts) <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'validate' END AS split FROM seq",
)


def _anova_ctes() -> list[tuple[str, str]]:
    """F test per entity; the p-value is a regularised incomplete beta by a continued fraction, 200 terms."""
    return [
        ("ag", "SELECT entity, state, count(*) AS n, avg(normalized_returns) AS m, sum(normalized_returns) AS s, var_pop(normalized_returns) * count(*) AS w FROM labeled WHERE state IS NOT NULL GROUP BY 1, 2"),
        ("atot", "SELECT entity, count(*) AS k, sum(n) AS n, sum(s) / sum(n) AS g, sum(w) AS ssw FROM ag GROUP BY 1"),
        ("af", "SELECT t.entity, (sum(a.n * (a.m - t.g) * (a.m - t.g)) / (any_value(t.k) - 1)) / (any_value(t.ssw) / (any_value(t.n) - any_value(t.k))) AS f, CAST(any_value(t.k) - 1 AS DOUBLE) AS d1, CAST(any_value(t.n) - any_value(t.k) AS DOUBLE) AS d2 FROM atot t JOIN ag a ON a.entity = t.entity GROUP BY t.entity"),
        ("ax", "SELECT *, d2 / (d2 + d1 * f) AS x0, d2 / (d2 + d1 * f) >= (d2 / 2 + 1) / (d2 / 2 + d1 / 2 + 2) AS sw FROM af"),
        ("ab", "SELECT *, CASE WHEN sw THEN d1 / 2 ELSE d2 / 2 END AS a, CASE WHEN sw THEN d2 / 2 ELSE d1 / 2 END AS b, CASE WHEN sw THEN 1 - x0 ELSE x0 END AS x FROM ax"),
        (
            "cf",
            "SELECT entity, 0 AS m, a, b, x, CAST(1 AS DOUBLE) AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h FROM ab "
            "UNION ALL SELECT entity, m, a, b, x, 1 + e2 / c1 AS c, 1 / (1 + e2 * d1) AS d, h1 * (1 / (1 + e2 * d1)) * (1 + e2 / c1) AS h FROM ("
            "SELECT entity, m, a, b, x, e2, 1 + e1 / c AS c1, 1 / (1 + e1 * d) AS d1, h * (1 / (1 + e1 * d)) * (1 + e1 / c) AS h1 FROM ("
            "SELECT entity, m + 1 AS m, a, b, x, c, d, h, (m + 1) * (b - (m + 1)) * x / ((a - 1 + 2 * (m + 1)) * (a + 2 * (m + 1))) AS e1, "
            "-(a + m + 1) * (a + b + m + 1) * x / ((a + 2 * (m + 1)) * (a + 1 + 2 * (m + 1))) AS e2 FROM cf WHERE m < 200))",
        ),
        ("bt", "SELECT c.entity, exp(lgamma(c.a + c.b) - lgamma(c.a) - lgamma(c.b) + c.a * ln(c.x) + c.b * ln(1 - c.x)) * c.h / c.a AS i FROM cf c WHERE m = 200"),
        ("pv", "SELECT ab.entity, ab.f, CASE WHEN ab.sw THEN 1 - bt.i ELSE bt.i END AS p FROM ab JOIN bt ON ab.entity = bt.entity"),
    ]


MATERIALIZE.update({"cf", "ab"})


def _given_more(ctes: list[tuple[str, str]], final: str) -> str:
    return with_ctes(_pipe(MAIN) + given_ctes() + ctes, final, recursive=True)


ORACLES["anova_pvalue"] = _given_more(_anova_ctes(), f"SELECT entity, {rnd('f', 'f_stat')}, {rnd('p', 'p_value')} FROM pv")
ORACLES["anova_report"] = _given_more(
    _anova_ctes(),
    "SELECT entity, 'Layer 0, returns by regime: p = ' || printf('%.4f', p) || '; ' || CASE WHEN p < 0.01 THEN 'mean returns clearly differ between regimes (1% level)' "
    "WHEN p < 0.05 THEN 'mean returns differ between regimes (5% level)' WHEN p < 0.1 THEN 'mean returns may differ between regimes (10% level)' "
    "ELSE 'no difference of mean returns between regimes is shown' END AS report FROM pv",
)


def _density_2d(k: int) -> str:
    (a, b), (_, c) = (((0.5, 0.2), (0.2, 1.0)), ((2.0, -0.3), (-0.3, 1.5)))[k]
    m = ((-0.5, 0.0), (1.0, 0.5))[k]
    det = f"({D(a)} * {D(c)} - {D(b)} * {D(b)})"
    u, v = f"(vol_5 - {D(m[0])})", f"(market_vola - {D(m[1])})"
    return f"-0.5 * (2 * ln(2 * pi()) + ln({det}) + ({D(c)} * {u} * {u} - 2 * {D(b)} * {u} * {v} + {D(a)} * {v} * {v}) / {det})"


ORACLES["emission_logpdf_2d"] = with_ctes(
    _pipe(MAIN), f"SELECT entity, ts, {rnd(_density_2d(0), 'lb_0')}, {rnd(_density_2d(1), 'lb_1')} FROM features"
)

_LAYERS = [
    (
        "lay",
        "SELECT *, 'regime_layer0' AS layer FROM labeled UNION ALL SELECT f.*, CASE WHEN "
        f"ln({D(G_PI[0])}) + e.lb0 >= ln({D(G_PI[1])}) + e.lb1 THEN 0 ELSE 1 END AS state, 'sub_level_state' AS layer "
        "FROM features f JOIN em e ON f.entity = e.entity AND f.ts = e.ts",
    )
]
MATERIALIZE.add("lay")
ORACLES["layer_return_means"] = _given_more(
    _LAYERS, f"SELECT entity, layer, CAST(state AS INTEGER) AS state, {rnd('avg(normalized_returns)', 'mean_return')} FROM lay GROUP BY 1, 2, 3"
)
ORACLES["layer_feature_means"] = _given_more(
    _LAYERS, f"SELECT entity, layer, measure, CAST(state AS INTEGER) AS state, {rnd('avg(value)', 'mean_value')} FROM ({_unpivot('lay', 'entity, layer, state')}) GROUP BY 1, 2, 3, 4"
)
ORACLES["layer_regime_capture"] = _given_more(
    _LAYERS
    + [
        ("lthr", f"SELECT *, quantile_cont(value, 0.95) OVER (PARTITION BY entity, layer, measure) AS threshold FROM ({_unpivot('lay', 'entity, layer, state')})"),
        ("lhigh", "SELECT entity, layer, measure, state, count(*) AS cnt FROM lthr WHERE value >= threshold GROUP BY 1, 2, 3, 4"),
        ("lsh", "SELECT *, cnt / sum(cnt) OVER (PARTITION BY entity, layer, measure) AS share FROM lhigh"),
    ],
    f"SELECT g.entity, g.layer, g.measure, CAST(g.state AS INTEGER) AS state, {rnd('coalesce(s.share, 0)', 'share')} FROM (SELECT DISTINCT a.entity, a.layer, a.state, b.measure "
    "FROM lsh a JOIN lsh b ON a.entity = b.entity AND a.layer = b.layer) g LEFT JOIN lsh s ON g.entity = s.entity AND g.layer = s.layer AND g.measure = s.measure AND g.state = s.state",
)

_P37 = FeatureParams(vol_windows=(3, 7))
_M37 = ("vol_3", "vol_7", "market_vola")
_COLS37 = ", ".join(rnd(c, c) for c in _P37.feature_columns)
ORACLES["features_windows_3_7"] = with_ctes(_pipe(MAIN, _P37), f"SELECT entity, ts, {_COLS37} FROM features")
ORACLES["vol_quantiles_windows_3_7"] = with_ctes(
    _pipe(MAIN, _P37), f"SELECT entity, measure, {rnd('quantile_cont(value, 0.95)', 'threshold')} FROM ({_unpivot('features', 'entity', _M37)}) GROUP BY 1, 2"
)
ORACLES["series_with_spikes"] = with_ctes(
    _pipe(MAIN),
    f"SELECT entity, ts, measure, {rnd('value', 'value')}, measure <> 'normalized_returns' AND value > quantile_cont(value, 0.95) OVER (PARTITION BY entity, measure) AS spike "
    f"FROM ({_unpivot('features', 'entity, ts', ('normalized_returns', 'vol_5', 'vol_10', 'vol_20', 'market_vola'))})",
)
ORACLES["roundtrip_panel"] = ORACLES["entity_filter"]

def _roundtrip_sql() -> str:
    """The features with windows (3, 7) beside the path decoded on the usual ones."""
    other = []
    for name, body in features_ctes(_P37, PROXY):
        for old in ("f1", "f2", "proxy", "features"):
            body = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {old}_37", body)
        other.append((f"{name}_37", body.replace("f2.", "f2_37.")))
    return with_ctes(
        _pipe(MAIN) + given_ctes() + other,
        f"SELECT f.entity, f.ts, {', '.join(rnd(f'f.{c}', c) for c in _P37.feature_columns)}, s.raw_state AS regime_layer0 "
        "FROM features_37 f LEFT JOIN states s ON f.entity = s.entity AND f.ts = s.ts",
        recursive=True,
    )


ORACLES["roundtrip_state_labeled"] = _roundtrip_sql()
ORACLES["roundtrip_models"] = with_ctes(
    _pipe(MAIN),
    "SELECT e.entity, CAST(f.l AS INTEGER) AS layer_idx, CAST(f.i AS INTEGER) AS from_state, CAST(f.j AS INTEGER) AS to_state, round(f.p + 1e-9, 6) AS prob "
    "FROM (SELECT DISTINCT entity FROM features) e CROSS JOIN (VALUES "
    + ", ".join(f"({layer}, {i}, {j}, {D(a[i][j])})" for layer, a in ((0, G_A), (1, L1_A)) for i in range(2) for j in range(2))
    + ") f(l, i, j, p)",
)
ORACLES["fit_failures"] = with_ctes(
    _pipe(MAIN), "SELECT e.entity, CAST(s.s AS INTEGER) AS seed, s.s = 1 AS failed, s.s = 1 AS no_loglik FROM (SELECT DISTINCT entity FROM features) e CROSS JOIN (VALUES (0), (1)) s(s)"
)
_CANDIDATES = _pipe(MAIN) + given_ctes()[:1] + candidate_ctes("ca_", G_PI, G_A, G_MU, G_VAR) + candidate_ctes("cb_", B_PI, B_A, B_MU, B_VAR)
ORACLES["best_score_given"] = with_ctes(
    _CANDIDATES, f"SELECT a.entity, {rnd('greatest(a.score, b.score)', 'best_score')} FROM ca_score a JOIN cb_score b ON a.entity = b.entity", recursive=True
)
ORACLES["select_best_neg_bic"] = with_ctes(
    _CANDIDATES,
    "SELECT entity, seed, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, seed) AS rn FROM ("
    + " UNION ALL ".join(
        f"SELECT f.entity, {seed} AS seed, 2 * f.lc - 7 * ln(e.n) AS score FROM {p}fwd f JOIN (SELECT DISTINCT entity, n FROM {p}em) e ON f.entity = e.entity AND f.t = e.n"
        for seed, p in ((0, "ca_"), (1, "cb_"))
    )
    + ")) WHERE rn = 1",
    recursive=True,
)


def _em_steps_sql(rounds: int) -> str:
    """Unrolled Baum-Welch: per round the densities, forward and backward recursions, and the new parameters."""
    mu, var = ((-0.5, 0.0), (1.0, 0.5)), ((0.5, 0.2, 1.0), (2.0, -0.3, 1.5))
    start = {"pi0": 0.5, "pi1": 0.5, "a00": 0.9, "a01": 0.1, "a10": 0.1, "a11": 0.9}
    for k in range(2):
        start |= {f"m{k}u": mu[k][0], f"m{k}v": mu[k][1], f"s{k}uu": var[k][0], f"s{k}uv": var[k][1], f"s{k}vv": var[k][2]}
    ctes = [
        ("es", "SELECT entity, vol_5 AS u, market_vola AS v, row_number() OVER (PARTITION BY entity ORDER BY ts) AS t, count(*) OVER (PARTITION BY entity) AS n FROM features"),
        ("par0", "SELECT entity, " + ", ".join(f"{D(x)} AS {c}" for c, x in start.items()) + " FROM (SELECT DISTINCT entity FROM es)"),
    ]
    for r in range(rounds):
        lb = []
        for k in range(2):
            det = f"(p.s{k}uu * p.s{k}vv - p.s{k}uv * p.s{k}uv)"
            u, v = f"(e.u - p.m{k}u)", f"(e.v - p.m{k}v)"
            lb.append(f"-0.5 * (2 * ln(2 * pi()) + ln({det}) + (p.s{k}vv * {u} * {u} - 2 * p.s{k}uv * {u} * {v} + p.s{k}uu * {v} * {v}) / {det}) AS l{k}")
        ctes += [
            (
                f"ed{r}",
                "SELECT *, exp(l0 - greatest(l0, l1)) AS b0, exp(l1 - greatest(l0, l1)) AS b1 FROM "
                f"(SELECT e.entity, e.t, e.n, e.u, e.v, p.pi0, p.pi1, p.a00, p.a01, p.a10, p.a11, {', '.join(lb)} FROM es e JOIN par{r} p ON e.entity = p.entity)",
            ),
            (
                f"ef{r}",
                f"SELECT entity, t, pi0 * b0 / (pi0 * b0 + pi1 * b1) AS f0, pi1 * b1 / (pi0 * b0 + pi1 * b1) AS f1 FROM ed{r} WHERE t = 1 "
                "UNION ALL SELECT entity, t, w0 / (w0 + w1), w1 / (w0 + w1) FROM (SELECT e.entity, e.t, (f.f0 * e.a00 + f.f1 * e.a10) * e.b0 AS w0, "
                f"(f.f0 * e.a01 + f.f1 * e.a11) * e.b1 AS w1 FROM ef{r} f JOIN ed{r} e ON e.entity = f.entity AND e.t = f.t + 1)",
            ),
            (
                f"eb{r}",
                f"SELECT entity, t, CAST(1 AS DOUBLE) AS z0, CAST(1 AS DOUBLE) AS z1 FROM ed{r} WHERE t = n "
                "UNION ALL SELECT entity, t, y0 / greatest(y0, y1), y1 / greatest(y0, y1) FROM (SELECT e.entity, e.t - 1 AS t, "
                f"e.a00 * e.b0 * z.z0 + e.a01 * e.b1 * z.z1 AS y0, e.a10 * e.b0 * z.z0 + e.a11 * e.b1 * z.z1 AS y1 "
                f"FROM eb{r} z JOIN ed{r} e ON e.entity = z.entity AND e.t = z.t WHERE z.t > 1)",
            ),
            (
                f"eg{r}",
                f"SELECT e.entity, e.t, e.u, e.v, f.f0 * z.z0 / (f.f0 * z.z0 + f.f1 * z.z1) AS g0, f.f1 * z.z1 / (f.f0 * z.z0 + f.f1 * z.z1) AS g1 "
                f"FROM ed{r} e JOIN ef{r} f ON e.entity = f.entity AND e.t = f.t JOIN eb{r} z ON e.entity = z.entity AND e.t = z.t",
            ),
            (
                f"ex{r}",
                "SELECT entity, " + ", ".join(f"sum(x{i}{j} / (x00 + x01 + x10 + x11)) AS x{i}{j}" for i in range(2) for j in range(2)) + " FROM (SELECT e.entity, "
                + ", ".join(f"f.f{i} * e.a{i}{j} * e.b{j} * z.z{j} AS x{i}{j}" for i in range(2) for j in range(2))
                + f" FROM ed{r} e JOIN ef{r} f ON f.entity = e.entity AND f.t = e.t - 1 JOIN eb{r} z ON z.entity = e.entity AND z.t = e.t) GROUP BY entity",
            ),
            (
                f"em{r}_",
                "SELECT entity, max(CASE WHEN t = 1 THEN g0 END) AS pi0, max(CASE WHEN t = 1 THEN g1 END) AS pi1, "
                + ", ".join(f"sum(g{k} * {c}) / sum(g{k}) AS m{k}{c}" for k in range(2) for c in "uv")
                + f" FROM eg{r} GROUP BY entity",
            ),
            (
                f"par{r + 1}",
                "SELECT m.entity, any_value(m.pi0) AS pi0, any_value(m.pi1) AS pi1, "
                + ", ".join(f"any_value(x.x{i}{j} / (x.x{i}0 + x.x{i}1)) AS a{i}{j}" for i in range(2) for j in range(2))
                + ", "
                + ", ".join(f"any_value(m.m{k}{c}) AS m{k}{c}" for k in range(2) for c in "uv")
                + ", "
                + ", ".join(f"sum(g.g{k} * (g.{c[0]} - m.m{k}{c[0]}) * (g.{c[1]} - m.m{k}{c[1]})) / sum(g.g{k}) AS s{k}{c}" for k in range(2) for c in ("uu", "uv", "vv"))
                + f" FROM eg{r} g JOIN em{r}_ m ON g.entity = m.entity JOIN ex{r} x ON x.entity = m.entity GROUP BY m.entity",
            ),
        ]
        MATERIALIZE.update({f"ed{r}", f"ef{r}", f"eb{r}", f"eg{r}", f"par{r + 1}"})
    names = {"u": "0", "v": "1"}
    columns = [rnd(f"pi{k}", f"pi_{k}") for k in range(2)] + [rnd(f"a{i}{j}", f"a_{i}{j}") for i in range(2) for j in range(2)]
    columns += [rnd(f"m{k}{c}", f"mu_{k}_{names[c]}") for k in range(2) for c in "uv"]
    columns += [rnd(f"s{k}{c}", f"var_{k}_{names[c[0]]}{names[c[1]]}") for k in range(2) for c in ("uu", "uv", "vv")]
    return with_ctes(_pipe(MAIN) + ctes, f"SELECT entity, {', '.join(columns)} FROM par{rounds}", recursive=True)


MATERIALIZE.add("es")
ORACLES["hmm_em_steps_3"] = _em_steps_sql(3)
ORACLES["train_val_split_custom"] = with_ctes(
    _pipe(MAIN) + given_ctes()[:1],
    "SELECT entity, CASE WHEN t % 10 = 0 THEN 'validate' ELSE 'train' END AS split, count(*) AS n, min(ts) AS first_ts FROM seq GROUP BY 1, 2",
)
_LAYERED = ORACLES["layered_decode"]
ORACLES["manager_reuse"] = (
    _LAYERED[: _LAYERED.rindex("\nSELECT s.entity, s.ts")]
    + f"\nSELECT f.entity, f.ts, {rnd('f.normalized_returns', 'normalized_returns')}, a.state AS regime_layer0, b.state AS regime_layer1 FROM features f "
    "LEFT JOIN (SELECT s.entity, s.ts, m.state FROM states s JOIN rmap m ON s.entity = m.entity AND s.raw_state = m.raw_state) a ON f.entity = a.entity AND f.ts = a.ts "
    "LEFT JOIN (SELECT s.entity, s.ts, m.state FROM st1 s JOIN rmap1 m ON s.entity = m.entity AND s.raw_state = m.raw_state) b ON f.entity = b.entity AND f.ts = b.ts"
)


# ---------------------------------------------------------------- transition files, cache, model store, wide source, open registry


def _steps(states: str) -> str:
    """Shares of the steps between the states that a series visits; ``states`` has entity, l, ts, s."""
    return (
        "SELECT g.entity, g.l, g.i, g.j, coalesce(c.n, 0) / nullif(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.entity, g.l, g.i), 0) AS p FROM "
        f"(SELECT DISTINCT a.entity, a.l, a.s AS i, b.s AS j FROM {states} a JOIN {states} b ON a.entity = b.entity AND a.l = b.l) g LEFT JOIN "
        f"(SELECT entity, l, s AS i, nxt AS j, count(*) AS n FROM (SELECT *, lead(s) OVER (PARTITION BY entity, l ORDER BY ts) AS nxt FROM {states}) "
        "WHERE nxt IS NOT NULL GROUP BY ALL) c ON g.entity = c.entity AND g.l = c.l AND g.i = c.i AND g.j = c.j"
    )


MATERIALIZE.add("cut")
_RAGGED = "CASE entity WHEN 'N' THEN (vol_5 >= -0.5)::INT + (vol_5 >= 0.5)::INT WHEN 'R' THEN (vol_5 >= -1)::INT + (vol_5 >= 0)::INT + (vol_5 >= 1)::INT ELSE (vol_5 >= 0)::INT END"
ORACLES["roundtrip_transitions"] = with_ctes(
    _pipe(MAIN)
    + [
        ("cut", f"SELECT entity, ts, 0 AS l, {_RAGGED} AS s FROM features UNION ALL SELECT entity, ts, 1, (normalized_returns >= 0)::INT FROM features"),
        ("path", _steps("cut")),
    ],
    f"SELECT replace(entity, '^', '') AS entity, CAST(l AS INTEGER) AS layer_idx, CAST(i AS INTEGER) AS from_state, CAST(j AS INTEGER) AS to_state, {rnd('p', 'prob')} FROM path",
)
ORACLES["cache_refill"] = with_ctes(
    panel_ctes(PANELS[MAIN]),
    f"SELECT entity, ts, {rnd('price', 'price')} FROM prices WHERE (entity IN ('A', 'R') AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-07-01') "
    "OR (entity IN ('A', 'N', 'R', '^MKT') AND ts >= TIMESTAMP '1996-10-01' AND ts < TIMESTAMP '1998-04-01')",
)
_THRESHOLDS = _pipe(MAIN) + [
    ("q", "SELECT entity, quantile_cont(vol_20, 0.5) AS low, quantile_cont(vol_20, 0.9) AS high FROM features GROUP BY entity"),
    ("cut", "SELECT f.entity, ts, 0 AS l, (vol_20 >= low)::INT + (vol_20 >= high)::INT AS s FROM features f JOIN q ON f.entity = q.entity"),
]
ORACLES["threshold_regimes"] = with_ctes(_THRESHOLDS, "SELECT entity, ts, s AS raw_state, s AS state, 'regime_layer0' AS layer FROM cut")
ORACLES["threshold_transitions"] = with_ctes(
    [*_THRESHOLDS, ("path", _steps("cut"))], f"SELECT entity, 'regime_layer0' AS layer, i AS from_state, j AS to_state, {rnd('p', 'prob')} FROM path"
)
ORACLES["manager_refresh"] = with_ctes(
    _pipe(MAIN),
    f"SELECT entity, CASE WHEN entity IN ('A', 'R') THEN 2 ELSE 1 END::BIGINT AS n_models, {rnd('quantile_cont(v, 0.5)', 'low')}, {rnd('quantile_cont(v, 0.9)', 'high')} "
    "FROM (SELECT entity, CASE WHEN entity IN ('A', 'R') THEN 2 * vol_5 ELSE vol_5 END AS v FROM features) GROUP BY entity",
)
ORACLES["wide_source"] = (
    f"SELECT 'P' || l_partkey AS entity, CAST(date_trunc('year', l_shipdate) AS TIMESTAMP) AS ts, {rnd('avg(l_extendedprice)', 'price')} FROM lineitem WHERE l_shipdate IS NOT NULL AND l_partkey IS NOT NULL GROUP BY 1, 2"
)
