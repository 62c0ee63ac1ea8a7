"""Plain SQL for each relational query, written independently of the DataFrame code."""

from __future__ import annotations

RAW = ("price", "rate", "fx", "trend_a", "trend_b")
LAGS = (3, 6, 12, 20)
SPANS = (6, 12, 20)
LAG_NAMES = [f"{c}_lag{k}" for c in ("price", "rate", "fx") for k in LAGS]
PRICE_ONLY = [
    *[f"price_lag{k}" for k in LAGS],
    *[f"momentum_{k}" for k in SPANS],
    *[f"ma{n}_lag3" for n in SPANS],
    *[f"std{n}_lag3" for n in SPANS],
    "roc_lag3",
    "price_trend_12",
    "volatility_20",
]
ENGINEERED = [
    *LAG_NAMES,
    *[f"momentum_{k}" for k in SPANS],
    *[f"ma{n}_lag3" for n in SPANS],
    *[f"std{n}_lag3" for n in SPANS],
    "roc_lag3",
    "rate_change_lag3",
    "fx_change_lag3",
    "price_trend_12",
    "volatility_20",
]
INPUTS = [*RAW, *ENGINEERED]

TRAIN_FROM, TRAIN_TO, TEST_FROM, TEST_TO = 1995, 1997, 1998, 2001
SEED = 20240101


def rnd(expression: str, digits: int) -> str:
    """Rounded double without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def digits_of(name: str, std: int) -> int | None:
    """Decimals a feature is compared at; None where both engines do the same single operation."""
    if name.startswith("ma"):
        return 5
    if name.startswith("std"):
        return std
    return 8 if name.startswith("volatility") else None


def shown(name: str, std: int) -> str:
    digits = digits_of(name, std)
    return name if digits is None else f"{rnd(name, digits)} as {name}"


def rounded(names, std: int = 2) -> str:
    return ", ".join(shown(n, std) for n in names)


def pct(cur: str, prev: str) -> str:
    return (
        f"(case when {prev} <> 0 then {cur} / {prev} when {prev} = 0 and {cur} > 0 then 'infinity'::double "
        f"when {prev} = 0 and {cur} < 0 then '-infinity'::double end - 1.0)"
    )


def feature_exprs(names) -> dict[str, str]:
    """SQL of each engineered column over window ``w`` (rows) and frames f6, f12, f20."""
    out: dict[str, str] = {}
    for c in ("price", "rate", "fx"):
        for k in LAGS:
            out[f"{c}_lag{k}"] = f"lag({c}, {k}) over w"
    for k in SPANS:
        out[f"momentum_{k}"] = f"lag(price, 3) over w - lag(price, {k}) over w"
    for n in SPANS:
        out[f"ma{n}_lag3"] = f"case when count(price) over f{n} = {n} then avg(price) over f{n} end"
        out[f"std{n}_lag3"] = f"case when count(price) over f{n} = {n} then stddev_samp(price) over f{n} end"
    out["roc_lag3"] = pct("lag(price, 3) over w", "lag(price, 4) over w")
    out["rate_change_lag3"] = "lag(rate, 3) over w - lag(rate, 4) over w"
    out["fx_change_lag3"] = pct("lag(fx, 3) over w", "lag(fx, 4) over w")
    out["price_trend_12"] = (
        "case when count(price) over f12 = 12 then "
        "case when lag(price, 3) over w > lag(price, 14) over w then 1.0::double else 0.0::double end end"
    )
    out["volatility_20"] = (
        "case when count(price) over f20 = 20 then "
        "case when avg(price) over f20 <> 0 then (stddev_samp(price) over f20) / (avg(price) over f20) end end"
    )
    return {n: out[n] for n in names}


def feature_select(names) -> str:
    return ", ".join(f"{e} as {n}" for n, e in feature_exprs(names).items())


def windows(partition: str, order: str) -> str:
    frames = ", ".join(
        f"f{n} as (partition by {partition} order by {order} rows between {n + 2} preceding and 3 preceding)"
        for n in SPANS
    )
    return f"window w as (partition by {partition} order by {order}), {frames}"


def fill(column: str) -> str:
    past = "partition by series_id order by date rows between unbounded preceding and current row"
    ahead = "partition by series_id order by date rows between current row and unbounded following"
    return (
        f"coalesce(last_value({column} ignore nulls) over ({past}), "
        f"first_value({column} ignore nulls) over ({ahead})) as {column}"
    )


MARKET = """
market as (
  select cast(o_orderdate as date) as date,
         cast(sum(cast(o_totalprice as decimal(18,2))) as double) as price, count(*) as n_orders
  from orders group by 1)"""

SEGMENT = """
segment as (
  select c_mktsegment as series_id, cast(o_orderdate as date) as date,
         cast(sum(cast(o_totalprice as decimal(18,2))) as double) as price, count(*) as n_orders
  from orders join customer on o_custkey = c_custkey group by 1, 2)"""

RATES = """
ship as (
  select cast(l_shipdate as date) as date,
         cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) as rate,
         cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / sum(l_quantity) as fx
  from lineitem group by 1),
rates as (
  select date, case when isodow(date) < 6 then rate end as rate,
         case when date >= date '1995-06-01' then fx end as fx from ship)"""

TREND = """
weekly as (
  select cast(date_trunc('week', l_shipdate) as date) as date, count(*) as trend_a,
         cast(sum(l_quantity) as bigint) as trend_b
  from lineitem group by 1),
week_days as (
  select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date
  from (select cast(min(date) as timestamp) as lo, cast(max(date) as timestamp) as hi from weekly)),
trend as (
  select d.date, w.trend_a, w.trend_b from week_days d asof left join weekly w on d.date >= w.date)"""

ALIGNED = f"""{SEGMENT},{RATES},{TREND},
aligned as (
  select s.series_id, s.date, s.price, s.n_orders, r.rate, r.fx, t.trend_a, t.trend_b
  from segment s left join rates r on s.date = r.date left join trend t on s.date = t.date)"""

COMBINED = f"""{ALIGNED},
combined as (
  select series_id, date, {fill('price')}, {fill('n_orders')}, {fill('rate')}, {fill('fx')},
         {fill('trend_a')}, {fill('trend_b')}
  from aligned)"""

LABELLED = f"""{COMBINED},
changes as (
  select *, price - lag(price) over (partition by series_id order by date) as change from combined),
labelled as (
  select * exclude (change),
         cast(case when change > 0 then 2 when change < 0 then 1 else 0 end as int) as target from changes)"""

FEATURES = f"""{LABELLED},
wide as (select *, {feature_select(ENGINEERED)} from labelled {windows('series_id', 'date')}),
feats as (
  select *, cast(year(date) as int) as year from wide
  where {' and '.join(f'{c} is not null' for c in INPUTS)}),
model as (
  select * exclude (target), cast(case target when 1 then 0 when 2 then 1 end as int) as target
  from feats where target <> 0)"""

FOLDS = f"""{FEATURES},
fold_years as (select distinct year as fold_year from model where year between {TEST_FROM} and {TEST_TO}),
members as (
  select f.fold_year, case when m.year = f.fold_year then 'test' else 'train' end as role, m.*
  from fold_years f join model m on m.year <= f.fold_year and m.year >= {TRAIN_FROM})"""

N_LABELS = f"""{SEGMENT},
n_changes as (
  select *, n_orders - lag(n_orders) over (partition by series_id order by date) as change from segment),
n_labels as (
  select * exclude (change),
         cast(case when change > 0 then 2 when change < 0 then 1 else 0 end as int) as target from n_changes)"""

SCORED = """
scored as (
  select o_orderkey as row_id, cast(o_orderdate as date) as date, cast(year(o_orderdate) as int) as year,
         cast(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as int) as actual,
         least(floor(o_totalprice / 500.0) / 1000.0, 1.0) as probability_up from orders),
predictions as (
  select *, cast(case when probability_up > 0.5 then 1 else 0 end as int) as predicted from scored)"""

CELLS = f"""{SCORED},
cells as (
  select count(*) filter (where actual = 0 and predicted = 0) as tn,
         count(*) filter (where actual = 0 and predicted = 1) as fp,
         count(*) filter (where actual = 1 and predicted = 0) as fn,
         count(*) filter (where actual = 1 and predicted = 1) as tp from predictions),
metrics as (
  select tn, fp, fn, tp, tn + fp + fn + tp as test_samples,
         (tn + tp)::double / (tn + fp + fn + tp) as accuracy,
         ((tn + fp) * coalesce(2.0 * tn / nullif(2 * tn + fn + fp, 0), 0)
          + (tp + fn) * coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) / (tn + fp + fn + tp) as f1_score,
         coalesce(tp::double / nullif(tp + fp, 0), 0) as up_precision,
         coalesce(tn::double / nullif(tn + fn, 0), 0) as down_precision,
         coalesce(tp::double / nullif(tp + fn, 0), 0) as up_recall,
         coalesce(tn::double / nullif(tn + fp, 0), 0) as down_recall from cells)"""

RETURNS = f"""{SEGMENT},
ranked as (
  select series_id, date, price, row_number() over (partition by series_id order by date desc) as back from segment),
moved as (
  select *, {pct('price', 'lag(price) over (partition by series_id order by date)')} as ret
  from ranked where back <= 60),
stats as (
  select series_id, max(date) as last_date, arg_max(price, date) as last_price, count(ret) as n_returns,
         avg(ret) as mean_return, stddev_samp(ret) as std_return
  from moved group by 1)"""


def uniform(digest: str, start: int) -> str:
    return f"((('0x' || substr({digest}, {start}, 8))::bigint + 0.5) / 4294967296.0)"


PATHS = f"""{RETURNS},
steps as (
  select s.*, d.day, i.sim, k.step,
         md5(concat_ws('|', s.series_id, d.day::varchar, i.sim::varchar, k.step::varchar, '{SEED}')) as digest
  from stats s, (select unnest(range(1, 8)) as day) d, (select unnest(range(0, 10)) as sim) i,
       (select unnest(range(1, 8)) as step) k
  where k.step <= d.day),
paths as (
  select series_id, day, sim, any_value(last_date) as last_date, any_value(last_price) as last_price,
         any_value(last_price) * product(1.0 + mean_return + std_return
           * sqrt(-2.0 * ln({uniform('digest', 1)})) * cos(2.0 * pi() * {uniform('digest', 9)})) as sim_price
  from steps group by 1, 2, 3),
scored_paths as (
  select *, 1.0 / (1.0 + exp(-(sim_price / last_price - 1.0) / 10.0)) as probability_up from paths)"""

EVENTS = """
events_keyed as (select event_type as series_id, ts, event_id, value as price from events)"""


def fraction(what: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', id::varchar, '{what}', '{SEED}')), 1, 13))::bigint + 0.5) / 4503599627370496.0)"


SMOTE = f"""{SCORED},
points as (
  select row_id::varchar as series_id, date, actual as target, probability_up as f0, dayofyear(date) / 366.0::double as f1,
         (year - 1995) / 7.0::double as f2 from scored),
classes as (
  select count(*) filter (where target = 1) as up, count(*) filter (where target = 0) as down,
         case when up > down then 0 else 1 end as minority, least(up, down) as few, greatest(up, down) as many
  from points),
few as (
  select row_number() over (order by series_id, date) - 1 as idx, points.* from points, classes where target = minority),
picks as (
  select id, floor({fraction('row')} * few)::bigint as idx, floor({fraction('neighbour')} * 5)::int as rank,
         {fraction('step')} as step
  from classes, range(0, greatest(0, floor(many * 0.9::double - few))::bigint) r(id)),
near as (
  select a.idx, b.idx as neighbour,
         row_number() over (partition by a.idx order by (a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)
           + (a.f2 - b.f2) * (a.f2 - b.f2), b.idx) - 1 as rank
  from few a join few b on a.idx <> b.idx where a.idx in (select idx from picks) qualify rank < 5),
made as (
  select id, {', '.join(f'a.f{i} + step * (b.f{i} - a.f{i}) as f{i}' for i in range(3))}
  from picks join near using (idx, rank) join few a on a.idx = picks.idx join few b on b.idx = near.neighbour)"""


def q(ctes: str, select: str) -> str:
    return f"with {ctes.strip()} {select}"


def _one(names, ctes: str = FEATURES) -> str:
    """A single feature group, nulls kept, over the labelled frame."""
    return q(
        LABELLED,
        f"select series_id, date, {rounded(names)} from "
        f"(select *, {feature_select(names)} from labelled {windows('series_id', 'date')})",
    )


PRICE_ROWS = q(MARKET, "select date, price from market")
CONTEXT_COLUMNS = [c for c in INPUTS if c != "price"]

ORACLE: dict[str, str] = {
    # sources and sinks
    "src_csv_roundtrip": PRICE_ROWS,
    "src_csv_semicolon": q(RATES, f"select date, fx from rates"),
    "src_json_observations": q(RATES, f"select date, rate from rates"),
    "src_json_range": q(RATES, "select date, rate from rates where date between date '1996-03-10' and date '1998-09-20'"),
    "src_json_timeline": q(
        TREND,
        "select cast(date as timestamp) as date, cast(trend_a as int) as trend_a, cast(trend_b as int) as trend_b "
        "from weekly",
    ),
    "sink_roundtrip": q(SEGMENT, "select series_id, date, price, n_orders, cast(year(date) as int) as year from segment"),
    "sink_csv_roundtrip": q(N_LABELS, "select series_id, date, price, n_orders, target from n_labels"),
    "latest_snapshot": q(
        COMBINED,
        f"select series_id, strftime(date, '%Y-%m-%d') as date, price, rate, "
        f"fx, cast(trend_a as int) as trend_a, cast(trend_b as int) as trend_b from combined "
        "qualify row_number() over (partition by series_id order by date desc) = 1",
    ),
    # alignment
    "lookback_filter": q(
        MARKET, "select date, price, n_orders from market where date >= (select max(date) from market) - interval 3 year"
    ),
    "asof_upsample_daily": q(TREND, "select date, trend_a, trend_b from trend"),
    "left_align": q(
        ALIGNED,
        f"select series_id, date, price, rate, fx, trend_a, trend_b from aligned",
    ),
    "ffill_bfill": q(
        COMBINED, f"select series_id, date, rate, fx, trend_a, trend_b from combined"
    ),
    "combined_daily": q(
        COMBINED,
        "select series_id, date, row_number() over (partition by series_id order by date) - 1 as position, price, "
        f"n_orders, rate, fx, trend_a, trend_b from combined",
    ),
    "recent_history": q(
        SEGMENT,
        "select series_id, date, price from segment "
        "qualify row_number() over (partition by series_id order by date desc) <= 100",
    ),
    "append_future_row": q(
        RETURNS,
        "select series_id, date, price from segment union all "
        f"select series_id, last_date + 1, {rnd('last_price * (1.0 + mean_return)', 2)} from stats",
    ),
    "series_profile": q(
        COMBINED,
        "select series_id, min(date) as first_date, max(date) as last_date, count(*) as n_rows, "
        "cast(8 as int) as n_columns from combined group by 1",
    ),
    # labels
    "target_label": q(N_LABELS, "select series_id, date, n_orders, target from n_labels"),
    "target_distribution": q(N_LABELS, "select target, count(*) as n_rows from n_labels group by 1 order by 1"),
    "target_counts": q(
        N_LABELS,
        "select series_id, count(*) filter (where target = 0) as n_no_change, "
        "count(*) filter (where target = 1) as n_decrease, count(*) filter (where target = 2) as n_increase, "
        "count(distinct target) as n_classes from n_labels group by 1",
    ),
    "binary_target": q(
        N_LABELS,
        "select series_id, date, n_orders, cast(case target when 1 then 0 when 2 then 1 end as int) as target "
        "from n_labels where target <> 0",
    ),
    # features
    "lag_features": _one(LAG_NAMES),
    "momentum_features": _one([f"momentum_{k}" for k in SPANS]),
    "lagged_moving_average": _one([f"ma{n}_lag3" for n in SPANS]),
    "lagged_rolling_std": _one([f"std{n}_lag3" for n in SPANS]),
    "pct_change_lagged": _one(["roc_lag3", "fx_change_lag3"]),
    "diff_lagged": _one(["rate_change_lag3"]),
    "price_trend_flag": _one(["price_trend_12"]),
    "volatility_ratio": _one(["volatility_20"]),
    "features_full": q(
        FEATURES,
        f"select series_id, date, year, target, {rounded(['price', 'rate', 'fx'])}, trend_a, trend_b, "
        f"{rounded(ENGINEERED)} from feats",
    ),
    # the same operators over raw events, where a series grows with the data
    "event_positions": q(
        EVENTS,
        "select series_id, event_id, row_number() over (partition by series_id order by ts, event_id) - 1 as position "
        "from events_keyed",
    ),
    "event_target_label": q(
        EVENTS,
        "select series_id, event_id, cast(case when change > 0 then 2 when change < 0 then 1 else 0 end as int) as target "
        "from (select *, price - lag(price) over (partition by series_id order by ts, event_id) as change "
        "from events_keyed)",
    ),
    "event_features": q(
        EVENTS,
        f"select series_id, event_id, {rounded(PRICE_ONLY, std=6)} from "
        f"(select *, {feature_select(PRICE_ONLY)} from events_keyed {windows('series_id', 'ts, event_id')})",
    ),
    "event_asof_join": """
select p.user_id, p.ts, p.event_id, p.value, o.event_id as seen_event, o.event_type as seen_type, o.ts as seen_ts
from (select * from events where event_type = 'purchase') p
asof left join (select * from events where event_type <> 'purchase') o on p.user_id = o.user_id and p.ts > o.ts
""",
    "event_rolling_mad": q(
        EVENTS,
        f"select series_id, event_id, {rnd('m', 6)} as mad20_lag3 from (select series_id, event_id, "
        "case when count(price) over f = 20 then mad(price) over f end as m from events_keyed "
        "window f as (partition by series_id order by ts, event_id rows between 22 preceding and 3 preceding))",
    ),
    "event_exact_median": q(
        EVENTS, f"select series_id, count(price) as n, {rnd('median(price)', 6)} as median from events_keyed group by 1"
    ),
    "event_fill": """
select case when value < 10 then 'low' else 'high' end as series_id, event_id,
       coalesce(
         last_value(case when event_type = 'purchase' then value end ignore nulls) over (
           partition by case when value < 10 then 'low' else 'high' end order by ts, event_id
           rows between unbounded preceding and current row),
         first_value(case when event_type = 'purchase' then value end ignore nulls) over (
           partition by case when value < 10 then 'low' else 'high' end order by ts, event_id
           rows between current row and unbounded following)) as last_purchase
from events""",
    "smote_oversample": q(
        SMOTE,
        "select series_id, date, f0 as feature_0, f1 as feature_1, f2 as feature_2, target from points union all "
        "select 'synthetic-' || (id // 1000000), date '1970-01-01' + (id % 1000000)::int, f0, f1, f2, minority "
        "from made, classes",
    ),
    # scalars
    "scalar_dates": q(
        MARKET,
        "select date, strftime(date, '%Y-%m-%d') as iso_date, cast(year(date) as int) as year, "
        "cast(date - interval 70 year as date) as lookback_start, date + 7 as next_week, "
        "cast(epoch(date) as bigint) as epoch_seconds, cast(date as timestamp) as epoch_timestamp from market",
    ),
    "nan_to_num": f"""
select l_orderkey, l_linenumber, {rnd('''case when l_quantity <> 1 then l_discount / (l_quantity - 1) else 0.0 end''', 8)} as cleaned
from lineitem""",
    # folds
    "train_test_split": q(
        FEATURES,
        f"select series_id, date, year, target, case when year <= {TRAIN_TO} then 'train' else 'test' end as part "
        f"from model where year between {TRAIN_FROM} and {TEST_TO}",
    ),
    "test_years": q(
        FEATURES, f"select distinct year from model where year between {TEST_FROM} and {TEST_TO} order by 1"
    ),
    "walkforward_folds": q(FOLDS, "select cast(fold_year as int) as fold_year, role, series_id, date, target from members"),
    "walkforward_fold_counts": q(
        FOLDS,
        "select cast(fold_year as int) as fold_year, role, count(*) as n_rows, cast(sum(target) as bigint) as n_up, "
        "min(date) as first_date, max(date) as last_date from members group by 1, 2",
    ),
    "expanding_train_union": q(
        FOLDS,
        "select series_id, date, year, target from members "
        "where role = 'train' and fold_year = (select max(fold_year) from fold_years)",
    ),
    "class_weights": q(
        FOLDS,
        "select cast(fold_year as int) as fold_year, count(*) as n_train, count(*) filter (where target = 0) as n_down, "
        "count(*) filter (where target = 1) as n_up, "
        f"{rnd('count(*) / 2.0 / count(*) filter (where target = 0)', 9)} as weight_down, "
        f"{rnd('count(*) / 2.0 / count(*) filter (where target = 1)', 9)} as weight_up "
        "from members where role = 'train' group by 1",
    ),
    "fold_scaler_stats": q(
        f"""{FOLDS},
        long as (
          unpivot (select fold_year, {', '.join(f'cast({c} as double) as {c}' for c in INPUTS)} from members where role = 'train')
          on {', '.join(INPUTS)} into name feature value v)""",
        f"select cast(fold_year as int) as fold_year, feature, count(*) as n_train, {rnd('avg(v)', 4)} as mean, "
        f"{rnd('case when min(v) = max(v) then 1.0 else stddev_pop(v) end', 4)} as scale from long group by 1, 2",
    ),
    "standardized_features": q(
        f"""{FOLDS},
        scaler as (
          select fold_year, {', '.join(f'avg({c}) as m_{c}, case when min({c}) = max({c}) then 1.0 else stddev_pop({c}) end as s_{c}' for c in INPUTS)}
          from members where role = 'train' group by 1)""",
        "select series_id, date, cast(year as int) as year, target, "
        + ", ".join(f"{rnd(f'({c} - m_{c}) / s_{c}', 5)} as {c}" for c in INPUTS)
        + " from members m join scaler s on m.fold_year = s.fold_year where role = 'test'",
    ),
    # voting and reports
    "soft_vote": f"""
select o_orderkey as row_id, {rnd('p', 9)} as probability_up, cast(case when p > 0.5 then 1 else 0 end as int) as predicted
from (select o_orderkey, (p_lr * 2.0 + p_gbm * 1.0 + p_rf * 1.0) / 4.0 as p
      from (select o_orderkey, least(floor(o_totalprice / 500.0) / 1000.0, 1.0) as p_lr,
                   {uniform("md5(concat_ws('|', o_orderkey::varchar, 'gbm'))", 1)} as p_gbm,
                   {uniform("md5(concat_ws('|', o_orderkey::varchar, 'rf'))", 1)} as p_rf from orders))""",
    "hist_predictions": q(
        SCORED,
        "select row_id, date, year, actual, predicted, probability_up, "
        "case actual when 0 then 'DOWN' when 1 then 'UP' end as actual_label, "
        "case predicted when 0 then 'DOWN' when 1 then 'UP' end as predicted_label, "
        "cast(case when actual = predicted then 1 else 0 end as int) as correct from predictions",
    ),
    # metrics
    "confusion_matrix": q(
        CELLS,
        "select cast(0 as int) as actual, tn as predicted_down, fp as predicted_up from cells "
        "union all select cast(1 as int), fn, tp from cells",
    ),
    "classification_metrics": q(
        CELLS,
        "select tn, fp, fn, tp, test_samples, "
        + ", ".join(
            f"{rnd(c, 9)} as {c}"
            for c in ("accuracy", "f1_score", "up_precision", "down_precision", "up_recall", "down_recall")
        )
        + " from metrics",
    ),
    "sample_counts": q(
        SCORED,
        f"select count(*) filter (where year between {TRAIN_FROM} and {TRAIN_TO}) as training_samples, "
        f"count(*) filter (where year between {TEST_FROM} and {TEST_TO}) as test_samples from predictions",
    ),
    "accuracy_verdict": q(
        CELLS,
        f"select {rnd('accuracy', 9)} as accuracy, case when accuracy > 0.70 then 'overfit_warning' "
        "when accuracy between 0.55 and 0.65 then 'realistic' when accuracy < 0.55 then 'needs_tuning' end as verdict "
        "from metrics",
    ),
    "roc_auc": q(
        f"""{SCORED},
        by_score as (
          select probability_up as s, count(*) filter (where actual = 0) as neg, count(*) filter (where actual = 1) as pos
          from predictions group by 1),
        ranked_scores as (
          select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as below
          from by_score)""",
        "select cast(sum(pos) as bigint) as n_up, cast(sum(neg) as bigint) as n_down, "
        f"{rnd('sum(pos * (below + neg / 2.0))::double / (sum(pos)::double * sum(neg)::double)', 9)} as roc_auc "
        "from ranked_scores",
    ),
    # scenarios
    "return_stats": q(
        RETURNS,
        "select series_id, last_date, last_price, n_returns, "
        f"{rnd('mean_return', 8)} as mean_return, {rnd('std_return', 8)} as std_return from stats",
    ),
    "forecast_calendar": q(
        RETURNS,
        "select series_id, cast(day as int) as day, 'Day +' || day as day_label, last_date + cast(day as int) as date, "
        "strftime(last_date + cast(day as int), '%Y-%m-%d') as iso_date from stats, (select unnest(range(1, 8)) as day)",
    ),
    "mc_paths": q(
        PATHS,
        "select series_id, cast(day as int) as day, cast(sim as int) as sim, last_date + cast(day as int) as date, "
        f"{rnd('sim_price / last_price', 6)} as growth from paths",
    ),
    "mc_vote": q(
        PATHS,
        "select series_id, cast(day as int) as day, count(*) as n_sims, "
        "count(*) filter (where probability_up > 0.5) as n_up_votes, "
        "cast(case when count(*) filter (where probability_up > 0.5) * 2 > count(*) then 1 else 0 end as int) as vote, "
        f"{rnd('avg(1.0 - probability_up) * 100', 6)} as prob_down, {rnd('avg(probability_up) * 100', 6)} as prob_up "
        "from scored_paths group by 1, 2",
    ),
    "oof_facts": q(
        FOLDS,
        "select series_id, date, cast(year as int) as year, cast(target as int) as actual, "
        "case when target = 1 then 'UP' else 'DOWN' end as actual_label, true as probabilities_fit, "
        "true as vote_is_weighted_mean, true as class_follows from members where role = 'test'",
    ),
    "model_summary_facts": q(
        FOLDS,
        "select 'Ensemble (LR + GBM + RF)' as model, '1995-1997' as training_period, count(*) as test_samples, "
        f"{len(INPUTS)} as features_used, true as agrees, true as auc_fits from members where role = 'test'",
    ),
    "wf_logistic_facts": q(
        FOLDS,
        "select fold_year, count(*) as n_train, sum(target)::bigint as n_up, true as is_minimum from members "
        "where role = 'train' group by 1",
    ),
    "forecast_facts": q(
        PATHS,
        "select s.series_id, cast(any_value(l.last_date) as date) + cast(s.day as int) as date, "
        f"'Day +' || cast(cast(s.day as int) as varchar) as day, {rnd('median(sim_price)', 1)} as estimated_price, "
        f"{rnd('median(sim_price) - any_value(last_price)', 1)} as price_change, true as sums_to_100, "
        "true as confidence_is_shown from scored_paths s join (select series_id, max(date) as last_date from segment "
        "group by 1) l on s.series_id = l.series_id group by s.series_id, s.day",
    ),
    "mc_price_summary": q(
        PATHS,
        f"select series_id, cast(day as int) as day, {rnd('median(sim_price)', 1)} as estimated_price, "
        f"{rnd('median(sim_price) - any_value(last_price)', 1)} as price_change from scored_paths group by 1, 2",
    ),
    "scenario_features": q(
        f"""{FEATURES},
        history as (
          select series_id, date, {', '.join(RAW)} from feats
          qualify row_number() over (partition by series_id order by date desc) <= 50),
        extended as (
          select *, false as synthetic from history union all
          select series_id, date + 1, {', '.join(RAW)}, true from history
          qualify row_number() over (partition by series_id order by date desc) = 1),
        context as (
          select *, {feature_select(ENGINEERED)} from extended {windows('series_id', 'date')}),
        context_row as (select * from context where synthetic)""",
        f"select series_id, {rounded(['rate', 'fx'])}, trend_a, trend_b, {rounded(ENGINEERED)} from context_row "
        f"where {' and '.join(f'{c} is not null' for c in INPUTS)}",
    ),
}

# A table that was brought up to date in steps is the table.
ORACLE["features_incremental"] = ORACLE["features_full"]
