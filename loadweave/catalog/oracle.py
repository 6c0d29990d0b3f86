"""The same queries as SQL for DuckDB.

Numbers that both sides must agree on to the last digit are summed as whole
units (hundredths of a reading, millionths of an error) and divided once.
"""

from __future__ import annotations

from ..plans.features import ALL_FEATURES
from ..sources.dimensions import CALENDAR_REGIONS, SPAIN_RULES
from . import inputs as i

K = "cast(value as decimal(18,2))"
SLOT = "time_bucket(interval '15 minutes', ts)"
HOUR = "date_trunc('hour', ts)"
START, END = f"timestamp '{i.HOLDOUT_START}'", f"timestamp '{i.HOLDOUT_END}'"


def fsum(e: str, decimals: int = 2) -> str:
    """Order-independent sum of a double."""
    return f"(cast(sum(cast(round_even(({e}) * 1e{decimals}, 0) as bigint)) as double) / 1e{decimals})"


def favg(e: str, decimals: int = 2) -> str:
    return f"({fsum(e, decimals)} / nullif(count({e}), 0))"


def _keyed_sum(bucket: str, name: str, keys: str = "", out: str = "total_active_kw") -> str:
    group = "all"
    return f"select {keys}{bucket} as {name}, cast(sum({K}) as double) as {out} from events group by {group}"


CCK = "event_type as community_code, "
TOTAL = _keyed_sum(SLOT, "datetime_15min", out="kw")
COMM = _keyed_sum(SLOT, "datetime_15min", CCK, "kw")
CLIENT = _keyed_sum(SLOT, "datetime_15min", f"user_id as client_id, {CCK}", "kw")
IDX = "cast(hour(datetime_15min) * 4 + floor(minute(datetime_15min) / 15) as integer)"
DAY = "cast(datetime_15min as date)"

# feeds, weather, stations
HOURS = f"select {HOUR} as datetime_local, event_type, {K} as v, event_id from events"
FEEDS = f"""feeds as (
  select datetime_local, cast(sum(v) as double) as demand_fc,
    cast(sum(case when event_type = 'view' then v end) as double) as pv_fc,
    cast(sum(case when event_type = 'click' then v end) as double) as wind_fc
  from ({HOURS}) group by datetime_local)"""
WEATHER = f"""weather as (
  select datetime_local, event_type as community_code,
    case when min(event_id) % 17 <> 0 then cast(cast(sum(v) * 100 as bigint) % 4000 as double) / 100 - 5 end as temperature_2m,
    cast(cast(sum(v) * 100 as bigint) % 3000 as double) / 100 - 10 as dew_point_2m,
    cast(cast(sum(v) * 100 as bigint) % 101 as double) as cloud_cover,
    cast(cast(sum(v) * 100 as bigint) % 97 as double) as relative_humidity_2m,
    cast(datetime_local as date) as date
  from ({HOURS}) group by datetime_local, event_type)"""
STATIONS = f"""st as (
  select case when min(event_id) % 29 <> 0 then cast(ts as date) end as fecha, event_type as community_code,
    cast(cast(sum({K}) * 100 as bigint) % 4000 as double) / 100 as tmed,
    case when min(event_id) % 3 = 2 then cast(cast(sum({K}) * 100 as bigint) % 900 as double) / 100 end as prec,
    cast(cast(sum({K}) * 100 as bigint) % 2300 as double) / 100 as velmedia,
    case when min(event_id) % 2 = 0 then 'Varias' else '12:30' end as horatmax
  from events group by cast(ts as date), event_type)"""
DEGREES = """hours as (
  select datetime_local, date, community_code, temperature_2m,
    case when temperature_2m is not null then greatest(0.0, 18.0 - temperature_2m) end as hdd_hourly,
    case when temperature_2m is not null then greatest(0.0, temperature_2m - 22.0) end as cdd_hourly
  from weather{where})"""
_PERIOD = " where date between date '2024-01-02' and date '2024-01-29'"
WD = f"{WEATHER}, {DEGREES.format(where='')}"
REGION_CASE = "case community_code " + " ".join(f"when '{k}' then '{v}'" for k, v in i.COMMUNITY_REGION.items()) + " end"
REG_HOURS = f"{WD}, rh as (select *, {REGION_CASE} as nuts2_code from hours)"

# regional statistics
REGIONAL = f"""pop as (
  select n_name as nuts2_code, count(*) as population from customer join nation on c_nationkey = n_nationkey group by n_name),
area as (
  select n_name as nuts2_code, 'Region ' || n_nationkey as region_name,
    case when n_nationkey <> 7 then (n_nationkey % 5) * cast(0.02 as double) + cast(0.03 as double) end as area_km2 from nation),
dens as (
  select pop.*, region_name, area_km2, population / area_km2 as population_density,
    case when population / area_km2 is null then 'unknown' when population / area_km2 > 1500 then 'urban'
      when population / area_km2 > 300 then 'intermediate' else 'rural' end as urban_rural_class
  from pop left join area using (nuts2_code)),
sectors as (
  select n_name as nuts2_code, unnest([c_mktsegment, 'TOTAL']) as nace_r2, year(o_orderdate) as y, cast(o_totalprice as decimal(18,2)) as v
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
gva as (
  select nuts2_code, nace_r2, cast(sum(v) filter (where y = (select max(y) from sectors)) as double) as value
  from sectors group by nuts2_code, nace_r2),
share0 as (
  select nuts2_code,
    max(value) filter (where nace_r2 = 'MACHINERY') / max(value) filter (where nace_r2 = 'TOTAL') as industrial_index,
    max(value) filter (where nace_r2 = 'FURNITURE') / max(value) filter (where nace_r2 = 'TOTAL') as agricultural_share
  from gva group by nuts2_code),
shares as (
  select share0.*,
    (industrial_index - min(industrial_index) over ()) / (max(industrial_index) over () - min(industrial_index) over ()) as industrial_index_normalized,
    (agricultural_share - min(agricultural_share) over ()) / (max(agricultural_share) over () - min(agricultural_share) over ()) as agricultural_share_normalized
  from share0),
night as (
  select n_name as nuts2_code, cast(count(*) as double) as tourism_nights
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name),
tour0 as (
  select night.*, population, tourism_nights / population as tourism_nights_per_capita from night left join pop using (nuts2_code)),
tour as (
  select tour0.*, case when tourism_nights_per_capita > 1.5 * (select median(tourism_nights_per_capita) from tour0) then 1 else 0 end as is_holiday_destination
  from tour0),
gdp0 as (
  select nuts2_code, value / 1e6 * 1e6 / population as gdp_per_capita_eur from gva left join pop using (nuts2_code) where nace_r2 = 'TOTAL'),
gdp as (
  select gdp0.*, (gdp_per_capita_eur - min(gdp_per_capita_eur) over ()) / (max(gdp_per_capita_eur) over () - min(gdp_per_capita_eur) over ()) as gdp_per_capita_normalized
  from gdp0)"""
DEGREE_INDEX = f"""sums as (
  select nuts2_code, coalesce({fsum('hdd_hourly')}, 0.0) as hdd, coalesce({fsum('cdd_hourly')}, 0.0) as cdd
  from rh where nuts2_code is not null group by nuts2_code),
didx as (
  select sums.*,
    case when max(hdd) over () > min(hdd) over () then (hdd - min(hdd) over ()) / (max(hdd) over () - min(hdd) over ()) else 0.5 end as hdd_normalized,
    case when max(cdd) over () > min(cdd) over () then (cdd - min(cdd) over ()) / (max(cdd) over () - min(cdd) over ()) else 0.5 end as cdd_normalized
  from sums)"""


def _wide(inner: str, keys: str, value: str = "kw", fill: bool = False, extra: str = "") -> str:
    cols = ", ".join(
        (f"coalesce(max(case when ix = {n} then {value} end), 0.0)" if fill else f"max(case when ix = {n} then {value} end)") + f' as "{n}"'
        for n in range(96)
    )
    by = ", ".join(["date", *([keys] if keys else [])])
    return f"select {by}, {extra}{cols} from (select *, {DAY} as date, {IDX} as ix from ({inner})) group by {by}"


# calendar
def _rules(rules) -> str:
    rows = []
    for r in rules:
        kind = "fixed" if r.easter_offset is None else "easter"
        region = f"'{r.region}'" if r.region else "null"
        name = r.name.replace("'", "''")
        rows.append(f"('{name}', '{kind}', {r.month or 'null'}, {r.day or 'null'}, {r.easter_offset if kind == 'easter' else 'null'}, {region})")
    return f"rules(name, kind, m, d, off, region) as (values {', '.join(rows)})"


_EASTER = """e1 as (select y, y % 19 as a, y // 100 as b, y % 100 as c from years),
e2 as (select *, b // 4 as d, b % 4 as e, (b - (b + 8) // 25 + 1) // 3 as g, c // 4 as i, c % 4 as k from e1),
e3 as (select *, (19 * a + b - d - g + 15) % 30 as h from e2),
e4 as (select *, (32 + 2 * e + 2 * i - h - k) % 7 as l from e3),
e5 as (select *, (a + 11 * h + 22 * l) // 451 as m from e4),
easter as (select y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) as easter from e5)"""


def _calendar(years: str, rules=i.RULES, regions=i.COMMUNITIES) -> str:
    codes = ", ".join(f"'{c}'" for c in regions)
    per = []
    for c in regions:
        on = f"max(case when region = '{c}' then holiday else 0 end)"
        per.append(f"{on} as holiday_{c}")
        bank = f"max(case when region = '{c}' then greatest(holiday, closed) else 0 end)"
        per.append(f"{bank} as bank_holiday_{c}")
        per.append(f"max(case when region = '{c}' then bridge else 0 end) as bridge_{c}")
    names = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    dows = ", ".join(f"max(case when dow = {n} then 1 else 0 end) as dow_{name}" for n, name in enumerate(names))
    return f"""{_rules(rules)}, years as ({years}), {_EASTER},
hol as (
  select distinct date, name, region from (
    select case when kind = 'easter' then cast(easter + off as date)
      when m = 2 and d = 29 and not (y % 4 = 0 and (y % 100 <> 0 or y % 400 = 0)) then null
      else make_date(y, m, d) end as date, name, region
    from rules cross join easter) where date is not null),
spine as (select cast(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), interval 1 day)) as date) as date, y, cast(easter - 3 as date) as thursday from easter),
nat as (select date, string_agg(name, '; ' order by name) as name from hol where region is null group by date),
day_region as (
  select date, y, region, isodow(date) - 1 as dow,
    case when exists (select 1 from hol h where h.date = s.date and (h.region is null or h.region = r.region)) then 1 else 0 end as holiday,
    case when isodow(date) = 7 or (month(date) = 12 and day(date) in (24, 31)) or date = thursday then 1 else 0 end as closed
  from spine s cross join (select unnest([{codes}]) as region) r),
bridged as (
  select *, case when dow = 0 and lead(holiday) over w = 1 then 1 when dow = 4 and lag(holiday) over w = 1 then 1 else 0 end as bridge
  from day_region window w as (partition by region, y order by date)),
cal as (
  select date, max(case when nat.name is not null then 1 else 0 end) as is_national_holiday, max(coalesce(nat.name, '')) as national_holiday_name,
    {', '.join(per)},
    max(case when nat.name is not null then 1 else closed end) as is_bank_holiday,
    cast(sum(holiday) as integer) as num_regions_holiday, {dows},
    max(case when dow >= 5 then 1 else 0 end) as is_weekend,
    max(case when dow >= 5 or nat.name is not null then 1 else 0 end) as is_holiday
  from bridged left join nat using (date) group by date)"""


ALL_YEARS = "select distinct cast(year(o_orderdate) as integer) as y from orders union select distinct cast(year(ts) as integer) from events"

# baseline medians
def _medians(fn: str, recent: str | None) -> str:
    rec = f"{fn} filter (where date >= date '{recent}')" if recent else "cast(null as double)"
    return f"""days as (select distinct community_code, {DAY} as date from comm),
full_days as (
  select d.community_code, d.date, ix, coalesce(c.kw, 0.0) as kw
  from days d cross join (select unnest(range(96)) as ix) g
  left join (select *, {DAY} as date, {IDX} as ix from comm) c using (community_code, date, ix)),
base as (
  select community_code, cast(dayofweek(date) + 1 as integer) as day_of_week, cast(ix as integer) as interval_idx,
    {fn} as hist_global, {rec} as hist_recent, coalesce({rec}, {fn}) as hist
  from full_days group by community_code, dayofweek(date) + 1, ix)"""


DISC = "quantile_disc(kw, 0.5)"

# lags: demand, rolling mean and their shifts onto observed slots and the grid
LAGGED = f"""t as ({TOTAL}),
roll as (
  select datetime_15min, kw, case when count(kw) over w >= 96 then cast(sum(cast(kw as decimal(18,2))) over w as double) / count(kw) over w end as rm
  from t window w as (order by datetime_15min rows between 671 preceding and current row)),
axis as (
  select datetime_15min from t union
  select unnest(generate_series({START}, {END} - interval 15 minute, interval 15 minute))),
lagged as (
  select a.datetime_15min, t.kw as demand_kw, l7.kw as demand_lag_7d, l1.kw as demand_lag_1d, r.rm as rolling_mean_7d
  from axis a left join t using (datetime_15min)
  left join t l7 on l7.datetime_15min = a.datetime_15min - interval 7 day
  left join t l1 on l1.datetime_15min = a.datetime_15min - interval 1 day
  left join roll r on r.datetime_15min = a.datetime_15min - interval 1 day)"""


def _carry(src: str, values: str, ts: str = "datetime_local") -> str:
    """Slots from the first to the last stamp, each with the latest source row."""
    return f"""select s.datetime_15min, {values} from (
    select unnest(generate_series((select min({ts}) from {src}), (select max({ts}) from {src}), interval 15 minute)) as datetime_15min) s
  asof join {src} x on x.{ts} <= s.datetime_15min"""


MEANS = f"""hmean as (
  select datetime_local, {', '.join(f'{favg(c)} as {c}' for c in ('dew_point_2m', 'temperature_2m', 'cloud_cover', 'relative_humidity_2m'))}
  from weather group by datetime_local)"""


def circle(name: str, e: str, period: int) -> str:
    two_pi = "6.283185307179586"
    return (
        f"round(sin({two_pi}::double * ({e}) / {period}.0::double), 9) + 0.0 as {name}_sin, "
        f"round(cos({two_pi}::double * ({e}) / {period}.0::double), 9) + 0.0 as {name}_cos"
    )


SEASONAL = ", ".join(
    (
        "hour(datetime_15min) + minute(datetime_15min) / 60.0::double as hour",
        "cast(isodow(datetime_15min) - 1 as integer) as day_of_week",
        "cast(month(datetime_15min) as integer) as month",
        circle("hour", "hour(datetime_15min) + minute(datetime_15min) / 60.0::double", 24),
        circle("dow", "isodow(datetime_15min) - 1", 7),
        circle("month", "month(datetime_15min)", 12),
    )
)

FEATURES = f"""with {LAGGED}, {WEATHER}, {MEANS}, {DEGREES.format(where='')}, {FEEDS},
{_calendar("select distinct cast(year(ts) as integer) as y from events")},
pv as (select datetime_local, pv_fc from feeds where pv_fc is not null),
wind as (select datetime_local, wind_fc from feeds where wind_fc is not null),
w15 as ({_carry('hmean', 'x.dew_point_2m, x.temperature_2m, x.cloud_cover, x.relative_humidity_2m')}),
d15 as ({_carry('feeds', 'x.demand_fc as demand_forecast')}),
p15 as ({_carry('pv', 'x.pv_fc as pv_forecast')}),
n15 as ({_carry('wind', 'x.wind_fc as wind_forecast')}),
deg as (select date, {favg('hdd_hourly')} as hdd_hourly, {favg('cdd_hourly')} as cdd_hourly from hours group by date),
joined as (
  select l.*, w15.* exclude (datetime_15min), demand_forecast, pv_forecast, wind_forecast, hdd_hourly, cdd_hourly,
    coalesce(cal.is_weekend, case when isodow(l.datetime_15min) >= 6 then 1 else 0 end) as is_weekend, coalesce(cal.is_holiday, 0) as is_holiday
  from lagged l left join w15 using (datetime_15min) left join d15 using (datetime_15min)
  left join p15 using (datetime_15min) left join n15 using (datetime_15min)
  left join deg on deg.date = cast(l.datetime_15min as date) left join cal on cal.date = cast(l.datetime_15min as date)
  where l.datetime_15min < {END}),
full_rows as (select *, {SEASONAL} from joined)
select datetime_15min, demand_kw, {', '.join(ALL_FEATURES)} from full_rows"""


# forecasts
def _naive(start: str, end: str) -> str:
    return f"""past as (select * from ({TOTAL}) where datetime_15min < {start}),
grid as (select unnest(generate_series({start}, {end} - interval 15 minute, interval 15 minute)) as datetime_15min),
pred as (
  select g.datetime_15min, coalesce(p.kw, (select cast(sum(cast(kw as decimal(18,2))) as double) / count(*) from past)) as prediction
  from grid g left join past p on p.datetime_15min = g.datetime_15min
    - to_days(7 * cast(ceil((date_diff('day', cast({start} as date), cast(g.datetime_15min as date)) + 1) / 7.0) as integer)))"""


NO_HISTORY = """select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-02 23:45:00', interval 15 minute)) as datetime_15min,
  cast(0 as double) as prediction"""
MEDIAN = f"""comm as (select * from ({COMM}) where datetime_15min < {START} - interval 1 day), {_medians(DISC, '2023-12-25')},
means as (select community_code, interval_idx, {favg('hist', 6)} as m from base group by community_code, interval_idx),
grid as (select unnest(generate_series({START}, {END} - interval 15 minute, interval 15 minute)) as datetime_15min),
pred as (
  select datetime_15min, {fsum('coalesce(b.hist, m.m)', 6)} as prediction
  from grid join means m on m.interval_idx = {IDX}
  left join base b on b.community_code = m.community_code and b.interval_idx = m.interval_idx and b.day_of_week = dayofweek(datetime_15min) + 1
  group by datetime_15min)"""


def _pairs(start: str, end: str) -> str:
    return f"""act as (select datetime_15min, kw as actual from ({TOTAL}) where datetime_15min >= {start} and datetime_15min < {end}),
pairs as (
  select datetime_15min, prediction, actual, prediction - actual as error,
    case when actual <> 0 then (prediction - actual) / actual end * 100.0 as pct_error
  from pred join act using (datetime_15min))"""


NAIVE_PAIRS = f"{_naive(START, END)}, {_pairs(START, END)}"
LONG_START, LONG_END = "timestamp '2024-01-15 00:00:00'", "timestamp '2024-02-05 00:00:00'"
MAE = f"{favg('abs(error)', 6)} as mae"
DAILY = f"""daily as (
  select cast(datetime_15min as date) as date, {MAE}, {favg('error', 6)} as bias, {favg('pct_error', 6)} as pct_bias, {favg('actual', 6)} as actual_mean
  from pairs group by cast(datetime_15min as date))"""
WEEKLY = f"""weekly as (
  select cast(floor(floor(date_diff('second', (select min(datetime_15min) from pairs), datetime_15min) / 86400.0) / 7.0) as bigint) as week,
    {favg('pct_error', 6)} as pct_bias, {MAE}
  from pairs group by all)"""


def _by(key: str, name: str) -> str:
    return f"""with {NAIVE_PAIRS}, g as (
  select cast({key} as integer) as {name}, {favg('actual', 6)} as actual_mean, {favg('prediction', 6)} as prediction_mean from pairs group by {key})
select *, prediction_mean - actual_mean as error_mean, (prediction_mean - actual_mean) / actual_mean * 100.0 as error_pct from g"""


def unit(*keys: str) -> str:
    """Hash of the keys as a value in [0, 1)."""
    text = " || '|' || ".join(["'42'", *keys])
    return f"(cast(('0x' || substr(md5({text}), 1, 8)) as bigint) / 4294967296.0::double)"


_SLOT_KEY = unit("community_code", "strftime(datetime_15min, '%Y-%m-%d %H:%M:%S')")


def _scale_cte(log: bool) -> str:
    x = "ln(1 + kw)" if log else "kw"
    back = "exp(least(greatest(z * sd + mu, 0.0), 30.0)) - 1" if log else "z * sd + mu"
    return f"""with comm as ({COMM}), {_medians(DISC, None)},
v as (select community_code, date, cast(ix as integer) as interval_idx, kw, {x} as x from full_days),
st as (
  select community_code, interval_idx, avg(x) as mu, case when stddev_pop(x) = 0 then 1.0 else stddev_pop(x) end as sd
  from v where date < date '2024-01-24' group by community_code, interval_idx),
z as (select v.*, mu, sd, case when mu is null then 0.0 else (x - mu) / sd end as z from v left join st using (community_code, interval_idx))
select community_code, date, interval_idx, kw, round(z, 5) + 0.0 as scaled, round(coalesce({back}, z), 4) + 0.0 as restored from z"""


def _lag_profiles() -> str:
    inner = _wide(TOTAL, "", fill=True)
    rows = f"p as (select row_number() over (order by date) - 1 as i, * from ({inner}))"
    cols = []
    for n in range(96):
        cols.append(f'p."{n}" as "profile_{n}"')
        cols.append(f'coalesce(a."{n}", p."{n}") as "lag7_{n}"')
        cols.append(f'coalesce(b."{n}", a."{n}", z."{n}") as "lag14_{n}"')
    return f"with {rows} select p.date, {', '.join(cols)} from p left join p a on a.i = p.i - 7 left join p b on b.i = p.i - 14 cross join (select * from p where i = 0) z"


def _feed_profile() -> str:
    cols = []
    for n in range(96):
        for s, c in (("d", "demand_fc"), ("p", "pv_fc"), ("w", "wind_fc")):
            cols.append(f'coalesce(max(case when ix = {n} then {c} end), 0.0) as "{n}_{s}"')
    ix = "cast(hour(datetime_local) * 4 + floor(minute(datetime_local) / 15) as integer)"
    return f"with {FEEDS} select date, {', '.join(cols)} from (select *, cast(datetime_local as date) as date, {ix} as ix from feeds) group by date"


def _profile_matrix() -> str:
    feed_cols = _feed_profile().split("select date, ", 1)[1]
    loads = ", ".join(f'max(case when ix = {n} then kw end) as "{n}"' for n in range(96))
    hist = ", ".join(f'max(case when interval_idx = {n} then hist end) as "hist_{n}"' for n in range(96))
    return f"""with comm as ({COMM}), {_medians(DISC, None)}, {FEEDS},
fp as (select date, {feed_cols}),
pr as (select community_code, date, {loads} from full_days group by community_code, date),
hb as (select community_code, day_of_week, {hist} from base group by community_code, day_of_week),
lb as (select community_code, cast(row_number() over (order by community_code) - 1 as integer) as community_idx from (select distinct community_code from comm))
select pr.*, hb.* exclude (community_code, day_of_week), fp.* exclude (date), community_idx, cast(dayofweek(pr.date) + 1 as integer) as day_of_week,
  cast(month(pr.date) as integer) as month, case when isodow(pr.date) >= 6 then 1 else 0 end as is_weekend
from pr join hb on hb.community_code = pr.community_code and hb.day_of_week = dayofweek(pr.date) + 1 join fp on fp.date = pr.date join lb on lb.community_code = pr.community_code"""


WITH_FEEDS = "select k.*, demand_fc, pv_fc, wind_fc, {day} as date, {ix} as ix from ({inner}) k left join feeds on feeds.datetime_local = k.datetime_15min"


def _joined(inner: str) -> str:
    return WITH_FEEDS.format(day=DAY, ix=IDX, inner=inner)


CLIENT_MEANS = ", ".join(f"{favg(f'{f}_fc')} as {f}_fc_mean" for f in ("demand", "pv", "wind"))

def _ols() -> str:
    """The normal equations of the next-day rows, solved by elimination, a step per CTE."""
    names = ["community_code_label", "day_of_week", "hour_of_day", "quarter_of_hour", "intercept"]
    n = len(names)
    x = [*names[:-1], "1"]
    first = [f"sum(cast({x[r]} as double) * {x[c]}) as a{r}{c}" for r in range(n) for c in range(n)]
    first += [f"sum(cast({x[r]} as double) * target) as a{r}{n}" for r in range(n)]
    steps = [f"s0 as (select {', '.join(first)}, count(*) as n from train)"]
    for k in range(n):
        cols = []
        for r in range(n):
            for c in range(n + 1):
                cols.append(f"a{r}{c} / a{k}{k} as a{r}{c}" if r == k else f"a{r}{c} - a{r}{k} * a{k}{c} / a{k}{k} as a{r}{c}")
        steps.append(f"s{k + 1} as (select {', '.join(cols)}, n from s{k})")
    rows = " union all ".join(f"select '{name}' as feature, round(a{r}{n}, 5) as coefficient, n from s{n}" for r, name in enumerate(names))
    return f"""with c as ({COMM}),
lab as (select community_code, row_number() over (order by community_code) - 1 as community_code_label from (select distinct community_code from c)),
rows as (
  select community_code, datetime_15min, community_code_label, isodow(datetime_15min) - 1 as day_of_week, hour(datetime_15min) as hour_of_day,
    floor(minute(datetime_15min) / 15) as quarter_of_hour, lead(kw, 96) over (partition by community_code order by datetime_15min) as target
  from c join lab using (community_code)),
train as (select * from rows where target is not null and {_SLOT_KEY} < 0.8), {', '.join(steps)} {rows}"""


# mean and population deviation from exact sums of hundredths
EXACT_MOMENTS = """cast(sum(cast(round_even({x} * 100, 0) as hugeint)) as double) / 100.0 / count({x}) as mu,
  sqrt(cast(count({x}) * sum(cast(round_even({x} * 100, 0) as hugeint) * cast(round_even({x} * 100, 0) as hugeint))
    - sum(cast(round_even({x} * 100, 0) as hugeint)) * sum(cast(round_even({x} * 100, 0) as hugeint)) as double)) / count({x}) / 100.0 as sd"""

ORACLE: dict[str, str] = {
    "total_15min": _keyed_sum(SLOT, "datetime_15min"),
    "community_15min": _keyed_sum(SLOT, "datetime_15min", CCK),
    "client_15min": _keyed_sum(SLOT, "datetime_15min", f"user_id as client_id, {CCK}"),
    "community_hour": _keyed_sum(HOUR, "datetime_hour", CCK),
    "community_day": _keyed_sum("cast(ts as date)", "date", CCK),
    "community_week": _keyed_sum("cast(date_trunc('week', ts) as timestamp)", "week_start", CCK),
    "community_month": _keyed_sum("cast(date_trunc('month', ts) as timestamp)", "month_start", CCK),
    "all_grains": " union all ".join(
        f"select '{g}' as grain, event_type as community_code, cast({b} as timestamp) as bucket, cast(sum({K}) as double) as total_active_kw from events group by all"
        for g, b in (
            ("15min", SLOT),
            ("hour", HOUR),
            ("day", "date_trunc('day', ts)"),
            ("week", "date_trunc('week', ts)"),
            ("month", "date_trunc('month', ts)"),
        )
    ),
    "daily_names": f"select event_type as community_code, cast(ts as date) as date, cast(sum({K}) as double) as total_active_kw, dayname(cast(ts as date)) as day_name from events group by all",
    "weekday_totals": f"select event_type as community_code, dayname(ts) as day_name, cast(sum({K}) as double) as sum_active_kw from events group by all",
    "weekday_pivot": "select event_type as community_code, "
    + ", ".join(
        f"cast(sum(case when dayname(ts) = '{n}' then {K} end) as double) as \"{n}\""
        for n in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    )
    + " from events group by 1",
    "month_pivot": "select cast(date_trunc('month', ts) as timestamp) as month_start, "
    + ", ".join(f"cast(sum(case when event_type = '{c}' then {K} end) as double) as \"{c}\"" for c in i.COMMUNITIES)
    + " from events group by 1",
    "multigrain_features": f"""with m as (select event_type as community_code, ts, {K} as v, {SLOT} as datetime_15min from events),
base as (select community_code, datetime_15min, cast(sum(v) as double) as total_active_kw from m group by all),
dd as (select community_code, cast(ts as date) as k, cast(sum(v) as double) as x from m group by all),
hh as (select community_code, date_trunc('hour', ts) as k, cast(sum(v) as double) as x from m group by all),
ww as (select community_code, date_trunc('week', ts) as k, cast(sum(v) as double) as x from m group by all),
mm as (select community_code, date_trunc('month', ts) as k, cast(sum(v) as double) as x from m group by all)
select b.community_code, cast(dense_rank() over (order by b.community_code) - 1 as integer) as community_code_label, datetime_15min, total_active_kw,
  dd.x as day_total_active_kw, hh.x as hour_total_active_kw, ww.x as week_total_active_kw, mm.x as month_total_active_kw,
  cast(isodow(datetime_15min) - 1 as integer) as day_of_week, cast(hour(datetime_15min) as integer) as hour_of_day,
  cast(floor(minute(datetime_15min) / 15) as integer) as quarter_of_hour
from base b
left join dd on dd.community_code = b.community_code and dd.k = cast(datetime_15min as date)
left join hh on hh.community_code = b.community_code and hh.k = date_trunc('hour', datetime_15min)
left join ww on ww.community_code = b.community_code and ww.k = date_trunc('week', datetime_15min)
left join mm on mm.community_code = b.community_code and mm.k = date_trunc('month', datetime_15min)""",
    "time_parts": f"""select datetime_15min, {DAY} as date, cast(date_trunc('week', datetime_15min) as timestamp) as week_start,
  cast(date_trunc('month', datetime_15min) as timestamp) as month_start, cast(hour(datetime_15min) as integer) as hour, cast(minute(datetime_15min) as integer) as minute,
  cast(day(datetime_15min) as integer) as day_of_month, cast(month(datetime_15min) as integer) as month, cast(year(datetime_15min) as integer) as year, {IDX} as interval_idx,
  cast(floor(minute(datetime_15min) / 15) as integer) as quarter_of_hour, cast(isodow(datetime_15min) - 1 as integer) as dow_mon0,
  cast(dayofweek(datetime_15min) + 1 as integer) as dow_sun1, cast(dayofweek(datetime_15min) + 1 as integer) as dow_from_mon0, dayname(datetime_15min) as day_name
from (select distinct {SLOT} as datetime_15min from events)""",
    "cyclic_features": f"""select datetime_15min, kw as total_kw, {SEASONAL}, case when isodow(datetime_15min) >= 6 then 1 else 0 end as is_weekend from ({TOTAL})""",
    "daily_profile": _wide(TOTAL, ""),
    "client_daily_profile": _wide(CLIENT, "client_id, community_code", fill=True),
    "community_daily_profile": _wide(COMM, "community_code", fill=True),
    "feed_profile": _feed_profile(),
    "daily_conditions": f"""with {FEEDS}, k as ({_joined(TOTAL)})
select date, cast(dayofweek(date) + 1 as integer) as day_of_week, cast(month(date) as integer) as month, case when isodow(date) >= 6 then 1 else 0 end as is_weekend,
  {favg('demand_fc')} as demand_fc_mean, max(demand_fc) as demand_fc_max, min(demand_fc) as demand_fc_min,
  {favg('pv_fc')} as pv_fc_mean, max(pv_fc) as pv_fc_max, {favg('wind_fc')} as wind_fc_mean, max(wind_fc) as wind_fc_max
from k group by date""",
    "client_conditions": f"""with {FEEDS}, k as ({_joined(CLIENT)})
select client_id, date, cast(dayofweek(date) + 1 as integer) as day_of_week, cast(month(date) as integer) as month, {CLIENT_MEANS} from k group by client_id, date""",
    "client_conditioned_profiles": f"""with {FEEDS}, k as ({_joined(CLIENT)})
select client_id, community_code, date, cast(dayofweek(date) + 1 as integer) as day_of_week, cast(month(date) as integer) as month,
  {', '.join(f"coalesce({favg(f'{f}_fc')}, 0.0) as {f}_fc_mean" for f in ('demand', 'pv', 'wind'))},
  {', '.join(f'coalesce(max(case when ix = {n} then kw end), 0.0) as "{n}"' for n in range(96))}
from k group by client_id, community_code, date""",
    "day_conditioned_profiles": f"""with {FEEDS}, k as ({_joined(TOTAL)})
select date, cast(dayofweek(date) + 1 as integer) as day_of_week, cast(month(date) as integer) as month, case when isodow(date) >= 6 then 1 else 0 end as is_weekend,
  {', '.join(f"coalesce({favg(f'{f}_fc')}, 0.0) as {f}_fc_mean, coalesce(max({f}_fc), 0.0) as {f}_fc_max" for f in ('demand', 'pv', 'wind'))},
  coalesce(min(demand_fc), 0.0) as demand_fc_min, {', '.join(f'coalesce(max(case when ix = {n} then kw end), 0.0) as "{n}"' for n in range(96))}
from k group by date""",
    "client_scaled_profiles": f"""with cl as (select client_id, datetime_15min, sum(cast(kw as decimal(18,2))) as kw from ({CLIENT}) group by all),
days as (select distinct client_id, {DAY} as date from cl),
v as (
  select d.client_id, d.date, cast(g.ix as integer) as interval_idx, coalesce(cast(c.kw as double), 0.0) as kw
  from days d cross join (select unnest(range(96)) as ix) g
  left join (select *, {DAY} as date, {IDX} as ix from cl) c using (client_id, date, ix)),
st as (select client_id, interval_idx, {EXACT_MOMENTS.format(x='kw')} from v where date < date '2024-01-24' group by all)
select v.*, case when mu is null then 0.0 else (kw - mu) / case when sd = 0 then 1.0 else sd end end as scaled from v left join st using (client_id, interval_idx)""",
    "baseline_scaled": f"""with comm as ({COMM}), {_medians(DISC, None)},
st as (select community_code, cast(ix as integer) as interval_idx, {EXACT_MOMENTS.format(x='kw')} from full_days group by all)
select community_code, day_of_week, interval_idx, hist, case when mu is null then 0.0 else (hist - mu) / case when sd = 0 then 1.0 else sd end end as scaled
from base left join st using (community_code, interval_idx)""",
    "candidate_matrix": f"""with t as ({TOTAL}), {WEATHER}, {MEANS}, {DEGREES.format(where='')}, {FEEDS}, {STATIONS},
w15 as ({_carry('hmean', 'x.dew_point_2m, x.temperature_2m, x.cloud_cover, x.relative_humidity_2m')}),
deg as (select date, {favg('hdd_hourly')} as hdd_hourly, {favg('cdd_hourly')} as cdd_hourly from hours group by date),
sd as (select fecha as date, {favg('tmed')} as tmed, {favg('prec')} as prec, {favg('velmedia')} as velmedia from st where fecha is not null group by fecha)
select t.datetime_15min, t.kw as demand_kw, w15.* exclude (datetime_15min), tmed, prec, velmedia, hdd_hourly, cdd_hourly,
  pv_fc as pv_forecast, wind_fc as wind_forecast, hour(t.datetime_15min) + minute(t.datetime_15min) / 60.0::double as hour,
  cast(isodow(t.datetime_15min) - 1 as integer) as day_of_week, cast(month(t.datetime_15min) as integer) as month,
  case when isodow(t.datetime_15min) >= 6 then 1 else 0 end as is_weekend,
  round(sin(2 * pi() * (hour(t.datetime_15min) + minute(t.datetime_15min) / 60.0::double) / 24), 9) + 0.0 as hour_sin,
  round(cos(2 * pi() * (hour(t.datetime_15min) + minute(t.datetime_15min) / 60.0::double) / 24), 9) + 0.0 as hour_cos
from t left join w15 using (datetime_15min) left join sd on sd.date = cast(t.datetime_15min as date)
left join deg on deg.date = cast(t.datetime_15min as date) left join feeds on feeds.datetime_local = t.datetime_15min""",
    "kept_codes": "select user_id as client_id, ts as datetime_local, event_type as community_code, value as active_kw from events where event_type in ('click', 'view') and user_id = 7",
    "time_split": f"select datetime_15min, kw as total_kw, case when datetime_15min < {START} then 'train' else 'test' end as part from ({TOTAL})",
    "calendar_full": f"with {_calendar(ALL_YEARS, SPAIN_RULES, CALENDAR_REGIONS)} select * from cal",
    "view_query": f"""select community_code, count(*) as days, max(kw) as highest
  from (select event_type as community_code, cast(ts as date) as date, cast(sum({K}) as double) as kw from events group by all) group by community_code""",
    "condition_one_hot": "select date, "
    + ", ".join(f"case when dayofweek(date) + 1 = {n} then 1 else 0 end as dow_{n}" for n in range(1, 8))
    + ", "
    + ", ".join(f"case when month(date) = {n} then 1 else 0 end as month_{n}" for n in range(1, 13))
    + " from (select distinct cast(ts as date) as date from events)",
    "median_baseline": f"with comm as ({COMM}), {_medians(DISC, '2024-01-15')} select * from base",
    "median_baseline_exact": f"with comm as ({COMM}), {_medians('quantile_cont(kw, 0.5)', '2024-01-15')} "
    "select community_code, day_of_week, interval_idx, round(hist_global, 4) as hist_global, round(hist_recent, 4) as hist_recent, round(hist, 4) as hist from base",
    "baseline_on_slots": f"""with comm as ({COMM}), {_medians(DISC, None)},
rows as (select community_code, datetime_15min, kw as total_active_kw, {DAY} as date, {IDX} as interval_idx, cast(dayofweek(datetime_15min) + 1 as integer) as day_of_week from comm)
select rows.*, coalesce(hist, 0.0) as hist from rows left join base using (community_code, day_of_week, interval_idx)""",
    "weekday_lag_profiles": _lag_profiles(),
    "clock_lags": f"""with t as ({TOTAL}) select t.datetime_15min, t.kw as total_kw, a.kw as lag_1d, b.kw as lag_7d, c.kw as lag_2d, d.kw as lag_3d from t
left join t a on a.datetime_15min = t.datetime_15min - interval 1 day left join t b on b.datetime_15min = t.datetime_15min - interval 7 day
left join t c on c.datetime_15min = t.datetime_15min - interval 2 day left join t d on d.datetime_15min = t.datetime_15min - interval 3 day""",
    "row_lags": f"""select datetime_15min, kw as total_kw, lag(kw, 96) over w as lag_1d, lag(kw, 672) over w as lag_7d, lag(kw, 192) over w as lag_2d,
  lag(kw, 288) over w as lag_3d from ({TOTAL}) window w as (order by datetime_15min)""",
    "next_day_target": f"""select * from (select community_code, datetime_15min, kw as total_active_kw,
  lead(kw, 96) over (partition by community_code order by datetime_15min) as target from ({COMM})) where target is not null""",
    "rolling_prev7d": f"""select datetime_15min, kw as total_kw, cast(sum(cast(kw as decimal(18,2))) over w as double) / nullif(count(kw) over w, 0) as rolling_mean_7d,
  round(stddev_samp(kw) over w, 6) as rolling_std_7d from ({TOTAL}) window w as (order by datetime_15min rows between 672 preceding and 1 preceding)""",
    "rolling_safe": f"with {LAGGED} select datetime_15min, kw as demand_kw, rm as rolling_mean_7d from roll",
    "lagged_demand": f"with {LAGGED} select * from lagged",
    "lagged_demand_10d": f"""with {LAGGED}
select a.datetime_15min, t.kw as demand_kw, l14.kw as demand_lag_7d, l10.kw as demand_lag_1d, r.rm as rolling_mean_7d
from axis a left join t using (datetime_15min)
left join t l14 on l14.datetime_15min = a.datetime_15min - interval 14 day
left join t l10 on l10.datetime_15min = a.datetime_15min - interval 10 day
left join roll r on r.datetime_15min = a.datetime_15min - interval 10 day""",
    "upsample_carry": f"with {WEATHER}, {MEANS} {_carry('hmean', 'x.dew_point_2m, x.temperature_2m, x.cloud_cover, x.relative_humidity_2m')}",
    "feed_slots": f"with {FEEDS}, pv as (select datetime_local, pv_fc from feeds where pv_fc is not null) {_carry('pv', 'x.pv_fc as pv_forecast')}",
    "feeds_outer": f"with {FEEDS} select * from feeds",
    "feed_join": f"with {FEEDS} select datetime_15min, kw as total_active_kw, demand_fc, pv_fc, wind_fc from ({TOTAL}) k left join feeds on feeds.datetime_local = k.datetime_15min",
    "spatial_mean": f"with {WEATHER}, {MEANS} select * from hmean",
    "calendar_features": f"with {_calendar(ALL_YEARS)} select * from cal",
    "holiday_breakdown": f"""with {_calendar(ALL_YEARS)} select count(*) filter (where is_weekend = 1 and is_national_holiday = 0) as weekend_only,
  count(*) filter (where is_weekend = 0 and is_national_holiday = 1) as national_on_weekday,
  count(*) filter (where is_weekend = 1 and is_national_holiday = 1) as national_on_weekend,
  count(*) filter (where is_holiday = 1) as holiday_days, count(*) filter (where is_holiday = 0) as working_days from cal""",
    "degree_hours": f"with {WEATHER}, {DEGREES.format(where=_PERIOD)} select * from hours",
    "degree_hours_null_as_zero": f"""with {WEATHER} select datetime_local, community_code, greatest(0.0, coalesce(18.0 - temperature_2m, 0.0)) as hdd_hourly,
  greatest(0.0, coalesce(temperature_2m - 22.0, 0.0)) as cdd_hourly from weather""",
    "degree_daily_mean": f"with {WD} select date, {favg('hdd_hourly')} as hdd_hourly, {favg('cdd_hourly')} as cdd_hourly from hours group by date",
    "degree_index": f"with {REG_HOURS}, {DEGREE_INDEX} select * from didx",
    "degree_monthly": f"""with {REG_HOURS} select nuts2_code, cast(year(date) as integer) as year, cast(month(date) as integer) as month, coalesce({fsum('hdd_hourly')}, 0.0) as hdd_monthly,
  coalesce({fsum('cdd_hourly')}, 0.0) as cdd_monthly from rh where nuts2_code is not null group by nuts2_code, year(date), month(date)""",
    "region_month_pattern": f"""with {REG_HOURS}, d as (
  select nuts2_code, date, {favg('temperature_2m')} as a, coalesce({fsum('hdd_hourly')}, 0.0) as h, coalesce({fsum('cdd_hourly')}, 0.0) as c
  from rh where nuts2_code is not null group by nuts2_code, date)
select nuts2_code, cast(month(date) as integer) as month, round({favg('a', 6)}, 1) as avg_temp, round({fsum('h')}, 1) as total_hdd, round({fsum('c')}, 1) as total_cdd
from d group by nuts2_code, month(date)""",
    "degree_summary": f"""with {REG_HOURS} select count(*) as records, count(distinct nuts2_code) as regions, count(distinct datetime_local) as hours,
  min(date) as min_date, max(date) as max_date, {favg('temperature_2m')} as avg_temperature, min(temperature_2m) as min_temperature,
  max(temperature_2m) as max_temperature, {favg('hdd_hourly')} as avg_hdd, max(hdd_hourly) as max_hdd, {favg('cdd_hourly')} as avg_cdd, max(cdd_hourly) as max_cdd from rh""",
    "region_temporal": f"with {REG_HOURS} select datetime_local, date, nuts2_code, temperature_2m, hdd_hourly, cdd_hourly from rh",
    "missing_codes": f"select distinct event_type as community_code from events where event_type not in ({', '.join(repr(k) for k in i.COMMUNITY_REGION)})",
    "regions_without_data": f"with {REG_HOURS} select r as nuts2_code from (select unnest(['ES11', 'ES12', 'ES13', 'ES24', 'ES61']) as r) where r not in (select nuts2_code from rh where nuts2_code is not null)",
    "latest_year": f"with {REGIONAL} select nuts2_code, nace_r2, value from gva",
    "sector_shares": f"with {REGIONAL} select * from shares",
    "density": f"with {REGIONAL} select * from dens",
    "density_class_counts": f"with {REGIONAL} select urban_rural_class, count(*) as n from dens group by 1",
    "tourism": f"with {REGIONAL} select * from tour",
    "gdp_per_capita": f"with {REGIONAL} select * from gdp",
    "gdp_extremes": f"""with {REGIONAL} select (select nuts2_code from gdp order by gdp_per_capita_eur desc, nuts2_code desc limit 1) as highest,
  max(gdp_per_capita_eur) as highest_value, (select nuts2_code from gdp order by gdp_per_capita_eur, nuts2_code limit 1) as lowest, min(gdp_per_capita_eur) as lowest_value from gdp""",
    "region_static": f"""with {REGIONAL}, {REG_HOURS}, {DEGREE_INDEX},
dx as (select case nuts2_code when 'ES61' then 'NATION_0' when 'ES24' then 'NATION_1' when 'ES12' then 'NATION_2' when 'ES13' then 'NATION_3' end as nuts2_code,
  hdd, cdd, hdd_normalized, cdd_normalized from didx)
select d.nuts2_code, region_name, population_density, urban_rural_class, pop.population as total_population, tourism_nights_per_capita, is_holiday_destination,
  industrial_index, industrial_index_normalized, gdp_per_capita_eur, gdp_per_capita_normalized, hdd, cdd, hdd_normalized, cdd_normalized,
  agricultural_share, agricultural_share_normalized,
  case when urban_rural_class = 'urban' then 1 else 0 end as is_urban, case when urban_rural_class = 'intermediate' then 1 else 0 end as is_intermediate,
  case when urban_rural_class = 'rural' then 1 else 0 end as is_rural, case when urban_rural_class = 'unknown' then 1 else 0 end as is_unknown
from dens d left join pop using (nuts2_code) left join tour using (nuts2_code) left join shares using (nuts2_code) left join gdp using (nuts2_code) left join dx using (nuts2_code)""",
    "temporal_with_static": f"""with {WD}, {REGIONAL}, h as (
  select case community_code when 'click' then 'NATION_0' when 'error' then 'NATION_1' when 'purchase' then 'NATION_2' when 'signup' then 'NATION_3' when 'view' then 'NATION_7' end as nuts2_code,
    datetime_local, date, temperature_2m, hdd_hourly, cdd_hourly from hours)
select h.*, population_density, urban_rural_class from h join dens using (nuts2_code)""",
    "weather_clean": f"with {STATIONS} select * from st where fecha is not null",
    "station_daily_mean": f"with {STATIONS} select fecha as date, {favg('tmed')} as tmed, {favg('prec')} as prec, {favg('velmedia')} as velmedia from st where fecha is not null group by fecha",
    "hourly_flatten": f"""with {WEATHER} select datetime_local, community_code, length(community_code) + 0.5::double as latitude, -3.5::double as longitude,
  650.0::double as elevation, temperature_2m, cloud_cover, date from weather""",
    "null_report": f"""with {WEATHER} select 'temperature_2m' as column_name, count(*) filter (where temperature_2m is null) as null_count,
  cast(count(*) filter (where temperature_2m is null) as double) / count(*) * 100 as null_pct from weather
  having count(*) filter (where temperature_2m is null) > 0 and count(temperature_2m) > 0""",
    "group_scale_roundtrip": _scale_cte(False),
    "log_scale_roundtrip": _scale_cte(True),
    "scaled_columns": f"with {FEEDS}, tr as (select * from feeds where datetime_local < {START}) select feeds.*, "
    + ", ".join(f"round(({c} - (select avg({c}) from tr)) / (select stddev_pop({c}) from tr), 6) + 0.0 as {c}_scaled" for c in ("demand_fc", "pv_fc", "wind_fc"))
    + " from feeds",
    "imputed_features": f"with {FEEDS}, tr as (select * from feeds where datetime_local < {START} and demand_fc is not null and pv_fc is not null and wind_fc is not null) select datetime_local, "
    + ", ".join(f"round(coalesce({c}, (select median({c}) from tr), 0.0), 4) as {c}" for c in ("demand_fc", "pv_fc", "wind_fc"))
    + f" from feeds where datetime_local >= {START}",
    "hashed_label_ids": """select hashed_id, cast(row_number() over (order by hashed_id) - 1 as integer) as client_idx
  from (select distinct user_id * 2654435761 % 1099511627776 as hashed_id from events)""",
    "label_ids": "select user_id as client_id, cast(row_number() over (order by user_id) - 1 as integer) as client_idx from (select distinct user_id from events)",
    "community_labels": "select event_type as community_code, cast(row_number() over (order by event_type) - 1 as integer) as community_idx from (select distinct event_type from events)",
    "label_cardinality": "select cast(count(distinct user_id) as integer) as num_clients from events",
    "community_codes": "select distinct event_type as community_code from events",
    "client_sample": f"select user_id as client_id, ts as datetime_local, event_type as community_code, value as active_kw from events where {unit('cast(user_id as varchar)')} < 0.3",
    "row_sample": f"select community_code, datetime_15min, kw as total_active_kw from ({COMM}) where {_SLOT_KEY} < 0.5",
    "rows_at_most": f"select community_code, datetime_15min, kw as total_active_kw from ({COMM}) order by {_SLOT_KEY}, community_code, datetime_15min limit 500",
    "next_day_ols_coefficients": _ols(),
    "random_split": f"""select *, case when {_SLOT_KEY} < 0.8 then 'train' else 'test' end as part from (
  select community_code, datetime_15min, kw as total_active_kw, lead(kw, 96) over (partition by community_code order by datetime_15min) as target from ({COMM})) where target is not null""",
    "feature_matrix": FEATURES,
    "naive_forecast": f"with {_naive(START, END)} select * from pred",
    "naive_no_history": NO_HISTORY,
    "median_no_history": NO_HISTORY,
    "naive_long_horizon": f"with {_naive(LONG_START, LONG_END)} select * from pred",
    "naive_week_ago": f"""with t as ({TOTAL}), grid as (select unnest(generate_series({LONG_START}, {LONG_END} - interval 15 minute, interval 15 minute)) as datetime_15min)
select g.datetime_15min, coalesce(t.kw, (select cast(sum(cast(kw as decimal(18,2))) as double) / count(*) from t where datetime_15min < {LONG_START})) as prediction
from grid g left join t on t.datetime_15min = g.datetime_15min - interval 7 day""",
    "median_forecast": f"with {MEDIAN} select * from pred",
    "holdout_mae": f"with {NAIVE_PAIRS} select count(*) as matched, {MAE} from pairs",
    "holdout_mae_median": f"with {MEDIAN}, {_pairs(START, END)} select count(*) as matched, {MAE} from pairs",
    "accuracy": f"with {NAIVE_PAIRS} select {MAE}, round(1.0 - sum(error * error) / (var_pop(actual) * count(*)), 6) as r2 from pairs",
    "bias_summary": f"""with {NAIVE_PAIRS}, b as (select {favg('actual', 6)} as actual_mean, {favg('prediction', 6)} as prediction_mean, {favg('error', 6)} as bias, {MAE},
  min(actual) as actual_min, max(actual) as actual_max, min(prediction) as prediction_min, max(prediction) as prediction_max,
  round(stddev_samp(actual), 6) as actual_std, round(stddev_samp(prediction), 6) as prediction_std from pairs)
select *, bias / actual_mean * 100.0 as bias_pct from b""",
    "error_by_hour": _by("hour(datetime_15min)", "hour"),
    "error_by_weekday": _by("isodow(datetime_15min) - 1", "day_of_week"),
    "daily_error": f"with {NAIVE_PAIRS}, {DAILY} select * from daily",
    "daily_error_summary": f"""with {NAIVE_PAIRS}, {DAILY} select count(*) as days, {favg('pct_bias', 6)} as pct_bias_mean, round(stddev_samp(pct_bias), 6) as pct_bias_std,
  min(pct_bias) as pct_bias_min, max(pct_bias) as pct_bias_max, count(*) filter (where pct_bias > 0) as positive_days, count(*) filter (where pct_bias < 0) as negative_days from daily""",
    "weekly_drift": f"with {_naive(LONG_START, LONG_END)}, {_pairs(LONG_START, LONG_END)}, {WEEKLY} select * from weekly",
    "verdict": f"""with {NAIVE_PAIRS}, {DAILY}, {WEEKLY}, s as (select bool_and(bias < 0) as all_under, bool_and(bias > 0) as all_over, stddev_samp(pct_bias) as sd,
  (select abs(arg_max(pct_bias, week) - arg_min(pct_bias, week)) from weekly) as dr from daily)
select all_under, all_over, round(sd, 6) as bias_std, round(dr, 6) as drift,
  case when (all_under or all_over) and sd < 5.0 then 'uniform bias' else 'possible overfitting' end as verdict from s""",
    "profile_table": f"""with {WEATHER} select community_code, count(*) as row_count, min(datetime_local) as min_time, max(datetime_local) as max_time,
  round({favg('temperature_2m')}, 1) as avg_temp_c, round({favg('cloud_cover')}, 1) as avg_cloud, round({fsum('dew_point_2m')}, 1) as total_dew from weather group by community_code""",
    "meter_overview": "select count(*) as row_count, count(distinct user_id) as client_count, min(ts) as min_time, max(ts) as max_time from events",
    "describe": " union all ".join(
        f"""select '{n}' as column_name, count({c}) as n, {favg(c)} as mean, round(stddev_samp({c}), 4) as std, cast(min({c}) as double) as min,
  round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as p50, round(quantile_cont({c}, 0.75), 4) as p75, cast(max({c}) as double) as max from events"""
        for n, c in (("client_id", "user_id"), ("active_kw", "value"))
    ),
    "table_head": f"with {WEATHER} select * from weather order by community_code, datetime_local limit 20",
    "density_ranked": f"with {REGIONAL} select * from dens order by population_density desc nulls last, nuts2_code",
    "submission": f"with {_naive(START, END)} select 'spark_team' as team_name, * from pred",
    "profile_rows": f"""with comm as ({COMM}), {_medians(DISC, None)}
select community_code, date, cast(ix as integer) as interval_idx, kw as prediction, cast(date as timestamp) + to_minutes(15 * ix) as datetime_15min from full_days""",
    "profile_matrix": _profile_matrix(),
    "feeds_for_days": f"""with {FEEDS},
slots as (select cast(datetime_local as date) as date, cast(hour(datetime_local) * 4 + floor(minute(datetime_local) / 15) as integer) as ix, demand_fc, pv_fc, wind_fc from feeds),
grid as (select d.date, ix from (select distinct date from slots) d cross join (select unnest(range(96)) as ix)),
full_feeds as (
  select date, unnest([3 * ix, 3 * ix + 1, 3 * ix + 2]) as pos, unnest([coalesce(demand_fc, 0.0), coalesce(pv_fc, 0.0), coalesce(wind_fc, 0.0)]) as v
  from grid left join slots using (date, ix)),
train as (select distinct event_type, cast(ts as date) as date from events where ts < timestamp '2024-01-24'),
med as (select pos, median(v) as m from full_feeds join train using (date) group by pos),
days as (select cast(unnest(generate_series(date '2024-01-29', date '2024-02-01', interval 1 day)) as date) as date)
select date, cast(pos as integer) as pos, round(coalesce(v, m), 4) as v from days cross join med left join full_feeds using (date, pos)""",
    "community_grid": f"select community_code, datetime_15min from (select distinct event_type as community_code from events) cross join (select unnest(generate_series({START}, {END} - interval 15 minute, interval 15 minute)) as datetime_15min)",
    "lag_matrix": f"""with {FEEDS}, t as ({TOTAL}), l as (
  select datetime_15min, kw as demand_kw, lag(kw, 96) over w as lag_1d, lag(kw, 672) over w as lag_7d, lag(kw, 192) over w as lag_2d, lag(kw, 288) over w as lag_3d,
    cast(sum(cast(kw as decimal(18,2))) over r as double) / nullif(count(kw) over r, 0) as rolling_mean_7d, round(stddev_samp(kw) over r, 6) as rolling_std_7d
  from t window w as (order by datetime_15min), r as (order by datetime_15min rows between 672 preceding and 1 preceding))
select l.*, cast(hour(datetime_15min) as integer) as hour, cast(minute(datetime_15min) as integer) as minute, cast(dayofweek(datetime_15min) + 1 as integer) as day_of_week,
  cast(day(datetime_15min) as integer) as day_of_month, cast(month(datetime_15min) as integer) as month, case when isodow(datetime_15min) >= 6 then 1 else 0 end as is_weekend,
  demand_fc as demand_forecast, pv_fc as pv_forecast, wind_fc as wind_forecast
from l join feeds on datetime_local = datetime_15min
where lag_7d is not null and rolling_std_7d is not null and demand_fc is not null and pv_fc is not null and wind_fc is not null""",
}

# the same rows by way of text
for _text, _plain in (("hourly_from_json", "hourly_flatten"), ("stations_from_json", "station_daily_mean"), ("statistics_from_csv", "latest_year")):
    ORACLE[_text] = ORACLE[_plain]


# fixed values: the candidates in the order of the regression
CANDIDATES = (
    "dew_point_2m", "temperature_2m", "cloud_cover", "relative_humidity_2m", "tmed", "prec", "velmedia", "hdd_hourly", "cdd_hourly",
    "pv_forecast", "wind_forecast", "hour", "day_of_week", "month", "is_weekend", "hour_sin", "hour_cos",
)


def _selection() -> str:
    """Normal equations of the standardised candidates, swept column by column; p-values through the quantiles of t."""
    rows = ORACLE["candidate_matrix"].replace("pv_fc as pv_forecast, wind_fc as wind_forecast", "pv15.pv_forecast, wind15.wind_forecast")
    rows = rows.replace("left join feeds on feeds.datetime_local = t.datetime_15min", "left join pv15 using (datetime_15min) left join wind15 using (datetime_15min)")
    series = "".join(
        f"{n}1 as (select datetime_local, {n}_fc from feeds where {n}_fc is not null), {n}15 as ({_carry(n + '1', f'x.{n}_fc as {n}_forecast')}), " for n in ("pv", "wind")
    )
    at = rows.rindex("\nselect t.datetime_15min")
    ctes, body = rows[:at], rows[at:]
    columns = [*CANDIDATES, "demand_kw"]
    k = len(columns)
    z = ", ".join(f"coalesce(({c} - avg({c}) over ()) / nullif(stddev_pop({c}) over (), 0), 0)" for c in columns)
    sums = ", ".join("[" + ", ".join(f"sum(z[{i}] * z[{j}]) / count(*)" for j in range(1, k + 1)) + "]" for i in range(1, k + 1))
    whole = " and ".join(f"{c} is not null" for c in columns)
    swept = "list_transform(m, lambda r, i: list_transform(r, lambda v, j: case when i = k + 1 and j = k + 1 then 1 / v when i = k + 1 then v / p when j = k + 1 then -v / p else v - r[k + 1] * m[k + 1][j] / p end))"
    names = "[" + ", ".join(f"'{c}'" for c in CANDIDATES) + "]"

    def quantile(z0: float) -> str:
        return f"({z0} + ({z0 ** 3 + z0}) / (4 * df) + ({5 * z0 ** 5 + 16 * z0 ** 3 + 3 * z0}) / (96 * df * df))"

    stars = "case " + " ".join(f"when t > {quantile(q)} then '{s}'" for q, s in ((3.2905267314918945, "***"), (2.5758293035489004, "**"), (1.959963984540054, "*"))) + " else '' end"
    return f"""{ctes.replace("with ", "with recursive ", 1)}, {series}candidates as ({body}),
complete as (select * from candidates where {whole}),
zs as (select [{z}] as z, stddev_pop(demand_kw) over () as spread from complete),
g as (select [{sums}] as m, count(*) as n, any_value(spread) as spread from zs),
sw as (
  select 0 as k, m, m[1][1] as p, []::integer[] as kept, n, spread from g
  union all
  select k + 1, case when p > 1e-6 then {swept} else m end as m2,
    case when p > 1e-6 then m[k + 2][k + 2] - m[k + 2][k + 1] * m[k + 1][k + 2] / p else m[k + 2][k + 2] end,
    case when p > 1e-6 then list_append(kept, k + 1) else kept end, n, spread
  from sw where k < {k - 1}),
done as (select m, kept, n, spread, n - len(kept) - 1 as df from sw where k = {k - 1}),
terms as (select unnest(kept) as i, m, n, spread, df from done),
fitted as (
  select {names}[i] as feature, m[i][{k}] * spread as coefficient, n, df,
    abs(m[i][{k}]) / sqrt(m[{k}][{k}] * m[i][i] / df) as t
  from terms),
starred as (select *, {stars} as significance from fitted)
select feature, round(coefficient, 4) as coefficient, significance,
  significance <> '' and abs(coefficient) >= (select quantile_cont(abs(coefficient), 0.5) from starred where significance <> '') as selected
from starred
union all select feature, null, null, false from (select unnest({names}) as feature) where feature not in (select feature from fitted)"""


ORACLE["ols_selected"] = _selection()

ORACLE["submission_written"] = ORACLE["submission"].replace("select 'spark_team' as team_name, *", "select 'spark_team' as team_name, *, true as in_this_run")
ORACLE["grains_written"] = f"""select s.*, h.total_active_kw as hour_kw from ({ORACLE['community_15min']}) s
join ({ORACLE['community_hour']}) h on h.community_code = s.community_code and h.datetime_hour = date_trunc('hour', s.datetime_15min)"""
ORACLE["temporal_partitions"] = f"""select * replace (case when nuts2_code = 'NATION_0' then temperature_2m + 1.0::double else temperature_2m end as temperature_2m), cast(year(date) * 100 + month(date) as integer) as month
from ({ORACLE['temporal_with_static']}) where population_density > 100 and year(date) * 100 + month(date) = 202401"""
WEATHER_COLUMNS = ("datetime_local", "community_code", "temperature_2m", "dew_point_2m", "cloud_cover", "relative_humidity_2m", "date")
ORACLE["weather_written"] = f"""with {WEATHER} {' union all '.join(f"select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count, min(datetime_local) as min_time, max(datetime_local) as max_time from weather" for c in WEATHER_COLUMNS)}"""
