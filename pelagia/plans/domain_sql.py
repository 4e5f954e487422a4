"""SQL of the domain queries: what DuckDB is asked for comparison. Each text states the operator's definition anew."""

from __future__ import annotations

from pelagia.plans.records import CHANNELS, TAG, q

SQL: dict[str, str] = {}

_FAMILY = {"a": ("a", {"g": "1", "m/s2": "1 / 9.80665", "mg": "0.001"}, 1.0), "g": ("g", {"rad/s": "1", "deg/s": "pi() / 180", "mrad/s": "0.001"}, 0.4), "m": ("m", {"uT": "1", "mG": "0.1", "nT": "0.001"}, 45.0)}


def q4(x: str) -> str:
    return f"round({x}, 4) + 0.0"


def _nearest(family: str) -> str:
    """The unit that brings a file's median vector nearest to what a tag usually feels, on a log scale."""
    _, units, centre = _FAMILY[family]
    options = ", ".join(f"{{'d': abs(ln(greatest({family}, 1e-12) * {f} / {centre})), 'u': '{u}'}}" for u, f in units.items())
    return f"case when {family} is not null then list_sort([{options}])[1].u end u{family}"


UNITS = "n as (select \"ID\", file_no, " + ", ".join(f"median(case when not isnan(sqrt({f}x*{f}x + {f}y*{f}y + {f}z*{f}z)) then sqrt({f}x*{f}x + {f}y*{f}y + {f}z*{f}z) end) {f}" for f in _FAMILY) + " from sensor_data group by \"ID\", file_no), u as (select \"ID\", file_no, " + ", ".join(map(_nearest, _FAMILY)) + " from n)"


def factor(family: str) -> str:
    return f"case u{family} " + " ".join(f"when '{u}' then {f}" for u, f in _FAMILY[family][1].items()) + " else 1 end"


#: The clean record in common units.
TAGU = UNITS + ", tag as (select * from (select record_id, s.\"ID\", s.file_no, datetime, epoch_us(datetime) us, epoch_us(datetime) / 1e6 t, " + ", ".join(f"case when not isnan({c}) then {c} end" + (f" * ({factor(c[0])})" if c[0] in "agm" and len(c) == 2 else "") + f" {c}" for c in CHANNELS) + ', row_number() over (partition by s."ID", datetime order by record_id) rn from sensor_data s left join u on s."ID" = u."ID" and s.file_no = u.file_no) where rn = 1)'

SQL["p4_found"] = f"with {UNITS} " + " union all ".join(f"select \"ID\", file_no, '{f}x' channel, u{f} unit from u where u{f} <> '{c}'" for f, c in (("a", "g"), ("g", "rad/s"), ("m", "uT")))
SQL["p4_converted"] = f"with {UNITS} select s.record_id, s.\"ID\", s.file_no, " + ", ".join(f"round(case when not isnan({f}{a}) then {f}{a} end * ({factor(f)}), 6) + 0.0 {f}{a}" for f in "agm" for a in "xyz") + ' from sensor_data s left join u on s."ID" = u."ID" and s.file_no = u.file_no'

# Quality

_NINE = [f + a for f in "agm" for a in "xyz"]
_CORR = "case when count({b}) filter ({a} is not null) >= 10 and stddev_samp({a}) filter ({b} is not null) >= 1e-9 and stddev_samp({b}) filter ({a} is not null) >= 1e-9 then corr({a}, {b}) end"
_METRICS = f"""m as (select "ID", count(*) n, {", ".join(f"count({c}) n_{c}, min({c}) lo_{c}, max({c}) hi_{c}" for c in [*_NINE, "temp"])},
{", ".join(_CORR.format(a=f"a{x}", b=f + x) + f" corr_{f}{x}" for f in "gm" for x in "xyz")}, median(sqrt(ax*ax + ay*ay + az*az)) accel_size, {", ".join(f"median(g{x}) bias_g{x}" for x in "xyz")},
{", ".join(f"(quantile_cont(m{x}, 0.02) + quantile_cont(m{x}, 0.98)) / 2 iron_{x}" for x in "xyz")} from tag group by "ID"),
e as (select t."ID", {", ".join(f"greatest(count(*) filter (t.{c} = m.lo_{c}), count(*) filter (t.{c} = m.hi_{c})) ends_{c}" for c in _NINE)}, median(sqrt((mx - iron_x)**2 + (my - iron_y)**2 + (mz - iron_z)**2)) radius,
  quantile_cont(sqrt((mx - iron_x)**2 + (my - iron_y)**2 + (mz - iron_z)**2), 0.75) - quantile_cont(sqrt((mx - iron_x)**2 + (my - iron_y)**2 + (mz - iron_z)**2), 0.25) width from tag t join m on t."ID" = m."ID" group by t."ID")"""


def _issue(check: str, channel: str, severity: str, value: str) -> str:
    return f"select \"ID\", '{check}' \"check\", '{channel}' channel, {severity} severity, round({value}, 6) \"value\" from x where {severity} is not null"


_ISSUES = f"{_METRICS}, x as (select m.*, e.* exclude (\"ID\") from m join e on m.\"ID\" = e.\"ID\"), issues as (" + " union all ".join(
    [_issue("duplication", name, f"case when corr_{f}x is not null and corr_{f}y is not null and corr_{f}z is not null and least(abs(corr_{f}x), abs(corr_{f}y), abs(corr_{f}z)) > 0.999 then 'error' end", f"least(abs(corr_{f}x), abs(corr_{f}y), abs(corr_{f}z))") for f, name in (("g", "gyro"), ("m", "mag"))]
    + [_issue("dead", c, f"case when n_{c} >= 10 and hi_{c} - lo_{c} < 1e-9 then 'error' end", f"hi_{c} - lo_{c}") for c in [*_NINE, "temp"]]
    + [_issue("dropout", c, f"case when 1 - n_{c} / n > 0.5 and n_{c} > 0 then 'warning' end", f"1 - n_{c} / n") for c in [*_NINE, "temp"]]
    + [_issue("saturation", c, f"case when n_{c} >= 50 and hi_{c} - lo_{c} >= 1e-9 then case when ends_{c} / n_{c} > 0.2 then 'error' when ends_{c} / n_{c} > 0.01 then 'warning' end end", f"ends_{c} / n_{c}") for c in _NINE]
    + [_issue("accel_scale", "accel", "case when abs(accel_size - 1) > 0.5 then 'error' when abs(accel_size - 1) > 0.2 then 'warning' end", "abs(accel_size - 1)")]
    + [_issue("gyro_bias", f"g{a}", f"case when abs(bias_g{a}) > 0.1 then 'info' end", f"bias_g{a}") for a in "xyz"]
    + [_issue("mag_plausibility", "mag", "case when radius <> 0 and width * 0.7413 / radius > 0.4 then 'warning' end", "width * 0.7413 / radius")]
) + ")"

SQL["int1_integrity"] = f'with {TAGU}, {_ISSUES} select "ID", "check", channel, severity, "value" from issues'
SQL["flt6_drop_failed"] = f"""with {TAGU}, {_ISSUES}, bad as (select distinct "ID", channel from issues where severity = 'error')
select t.record_id, {", ".join(f'case when not exists (select 1 from bad b where b."ID" = t."ID" and b.channel in ({names})) then {q(c)} end {c}' for c, names in (("ax", "'ax', 'accel'"), ("gx", "'gx', 'gyro'"), ("mx", "'mx', 'mag'"), ("temp", "'temp'")))} from tag t"""

_UNIT = ", ".join(f"case when sqrt(ax*ax + ay*ay + az*az) <> 0 then a{a} / sqrt(ax*ax + ay*ay + az*az) end u{a}" for a in "xyz")
SQL["sig8_coregistration"] = f"""with {TAGU}, v as (select *, {_UNIT} from tag),
d as (select *, {", ".join(f"(lead(u{a}) over w - lag(u{a}) over w) / (lead(t) over w - lag(t) over w) d{a}" for a in "xyz")} from v window w as (partition by "ID" order by us)),
p as (select "ID", dx d, gz * uy - gy * uz c from d where sqrt(gx*gx + gy*gy + gz*gz) > 0.15 union all select "ID", dy, gx * uz - gz * ux from d where sqrt(gx*gx + gy*gy + gz*gz) > 0.15 union all select "ID", dz, gy * ux - gx * uy from d where sqrt(gx*gx + gy*gy + gz*gz) > 0.15)
select "ID", round(case when count(c) filter (d is not null) >= 200 and stddev_samp(d) filter (c is not null) >= 1e-9 and stddev_samp(c) filter (d is not null) >= 1e-9 then corr(d, c) end, 6) + 0.0 coreg_corr, count(d) n from p group by "ID" """

SQL["qlt2_anomalies"] = f"""with {TAG}, r as (select *, case when row_number() over w = 1 or depth is distinct from lag(depth) over w then 1 else 0 end new, last_value(depth ignore nulls) over b px, last_value(case when depth is not null then t end ignore nulls) over b pt from tag
  window w as (partition by "ID" order by us), b as (partition by "ID" order by us rows between unbounded preceding and 1 preceding)),
k as (select *, sum(new) over (partition by "ID" order by us) run from r),
s as (select *, coalesce((abs(depth - px) > 0 and t - pt <> 0 and abs(depth - px) / (t - pt) > 5) or (depth > 0 and max(t) over (partition by "ID", run) - min(t) over (partition by "ID", run) >= 300), false) s from k),
l as (select *, max(case when s then t end) over (partition by "ID" order by us rows between unbounded preceding and 1 preceding) pl from s),
g as (select *, sum(case when s and t - pl > 300 then 1 else 0 end) over (partition by "ID" order by us) g from l),
z as (select *, count(*) over (partition by "ID", g, s) size, max(abs(depth)) over (partition by "ID", g, s) top from g)
select record_id, depth from z where s and (size <> 2 or abs(depth) = top)"""

# Regular grids

_GRID = f"""{TAG}, s as (select "ID", us, us - lag(us) over (partition by "ID" order by us) dt from tag),
g0 as (select "ID", min(us) a, max(us) z, round(median(case when dt > 0 then dt end))::bigint step from s group by "ID"),
g as (select "ID", step, unnest(range(a, z + 1, step)) us from g0 where step > 0),
b as (select g."ID", g.us, g.step, t.us bu, t.depth bd, t.temp bt from g asof left join tag t on g."ID" = t."ID" and g.us >= t.us),
n as (select b.*, t.us nu, t.depth nd, t.temp nt from b asof left join tag t on b."ID" = t."ID" and b.us <= t.us),
c as (select "ID", us, step, nu is null or us - bu <= nu - us e, bu, nu, bd, nd, bt, nt from n),
o as (select "ID", us, us / 1e6 t, abs(case when e then bu else nu end - us) <= 0.5 * step near, case when e then bd else nd end d0, case when e then bt else nt end t0 from c),
k as (select "ID", us, t, near, case when near then d0 end depth, case when near then t0 end "temp" from o),
f as (select *, {", ".join(f'last_value(case when {c} is not null then t end ignore nulls) over w {c}_ta, last_value({c} ignore nulls) over w {c}_a, first_value(case when {c} is not null then t end ignore nulls) over v {c}_tb, first_value({c} ignore nulls) over v {c}_b, count({c}) over w {c}_n' for c in ("depth", "temp"))} from k
  window w as (partition by "ID" order by us rows between unbounded preceding and current row), v as (partition by "ID" order by us rows between current row and unbounded following)),
h as (select *, {", ".join(f'count(*) filter ({c} is null) over (partition by "ID", {c}_n) {c}_gap' for c in ("depth", "temp"))} from f),
i as (select "ID", us, near, {", ".join(f'coalesce({c}, case when {c}_ta is not null and {c}_tb is not null and {c}_gap <= 5 then {c}_a + ({c}_b - {c}_a) * (t - {c}_ta) / ({c}_tb - {c}_ta) end) {c}' for c in ("depth", "temp"))} from h),
reg as (select *, case when near then 'observed' when depth is not null or "temp" is not null then 'interpolated' else 'gap' end state from i)"""
SQL["reg1_regular"] = f'with {_GRID} select "ID", us datetime, {q("depth")} depth, {q(chr(34) + "temp" + chr(34))} "temp", state from reg'
SQL["agg21_report"] = f"""with {_GRID}, nb as (select "ID", count(*) n_before from tag group by "ID"), dt as (select "ID", t - lag(t) over (partition by "ID" order by us) dt from tag), mid as (select "ID", median(dt) m from dt group by "ID"),
j as (select dt."ID", 1482.6 * median(abs(dt - m)) jitter_ms from dt join mid on dt."ID" = mid."ID" group by dt."ID"),
gg as (select *, sum(case when state = 'gap' and coalesce(ps, '') <> 'gap' then 1 else 0 end) over (partition by "ID" order by us) run from (select *, lag(state) over (partition by "ID" order by us) ps from reg)),
gl as (select "ID", count(*) n_gaps, max(l) largest_gap, median(l) median_gap from (select "ID", run, count(*) l from gg where state = 'gap' group by all) group by "ID"),
sh as (select "ID", count(*) n_after, {", ".join(f"100 * avg(case when state = '{s}' then 1.0 else 0.0 end) {s}_pct" for s in ("observed", "interpolated", "gap"))} from reg group by "ID"),
r as (select nb."ID", n_before, n_after, observed_pct, interpolated_pct, gap_pct, coalesce(n_gaps, 0) n_gaps, coalesce(largest_gap, 0) largest_gap, coalesce(median_gap, 0) median_gap, jitter_ms, 100 * (n_after / n_before - 1) added_pct from nb join sh on nb."ID" = sh."ID" left join gl on nb."ID" = gl."ID" left join j on nb."ID" = j."ID"),
s2 as (select *, case when gap_pct > 5 or interpolated_pct > 20 or added_pct > 100 then 'critical' when gap_pct > 1 or interpolated_pct > 5 or added_pct > 10 then 'review' else 'ok' end status from r)
select "ID", n_before, n_after, {", ".join(f"{q(c)} {c}" for c in ("observed_pct", "interpolated_pct", "gap_pct"))}, n_gaps, largest_gap, {q("median_gap")} median_gap, {q("jitter_ms")} jitter_ms, {q("added_pct")} added_pct, status,
{q("case status when 'critical' then 2e6 when 'review' then 1e6 else 0 end + gap_pct * 1000 + interpolated_pct * 10 + added_pct / 1e4")} severity from s2"""
SQL["sup12_coverage"] = f"""with {_GRID}, bins as (select "ID", ntile(100) over (partition by "ID" order by us) bin, case state when 'gap' then 2 when 'interpolated' then 1 else 0 end l from reg)
select "ID", bin, case max(l) when 2 then 'gap' when 1 then 'interpolated' else 'observed' end worst from bins group by "ID", bin"""

# Dives. The same runs as in the other dive queries: band 2, threshold 10, least 30 s, gaps of 600 s.

DIVE_TABLE = """dv as (select p.*, sum(case when dt > 600 then 1 else 0 end) over w gaps, lead(t) over w - t nx, depth - lag(depth) over w dz0, lag(dive_id) over w pid, min(t) over (partition by "ID") rec0, max(t) over (partition by "ID") rec1 from p window w as (partition by "ID" order by us)),
dt0 as (select "ID", dive_id, min(t) s, max(t) e, max(depth) max_depth, max(gaps) gaps, arg_max(nx, t) behind, bool_or(t = rec0) ts, bool_or(t = rec1) te, coalesce(max(case when pid is distinct from dive_id or dt is null then case when dt > 600 then 1 else 0 end end), 0) edge from dv where dive_id > 0 group by "ID", dive_id),
dt1 as (select *, e - s duration_s, not (ts or te or edge > 0 or coalesce(behind > 600, false)) complete, lead(s) over w - e inter_dive_s, case when lead(s) over w is not null then lead(gaps) over w > gaps or coalesce(behind > 600, false) end inter_dive_censored from dt0 window w as (partition by "ID" order by dive_id))"""

#: Phases by the vertical rate: a quarter of the 0.9 quantile of the dive's own rates, sustained over a twentieth of its rows.
RATE_PHASES = """v0 as (select record_id, "ID", us, t, dive_id, abs(depth) z, row_number() over w i, count(*) over (partition by "ID", dive_id) m, (abs(depth) - lag(abs(depth)) over w) / nullif(t - lag(t) over w, 0) v from p where dive_id > 0 window w as (partition by "ID", dive_id order by us)),
v1 as (select "ID", dive_id, 0.25 * quantile_cont(abs(v), 0.9) crit, arg_min(i, {'z': -z, 'i': i}) pk, greatest(3, ceil(0.05 * any_value(m))) len from v0 group by "ID", dive_id),
v2 as (select v0.*, crit, pk, len from v0 join v1 on v0."ID" = v1."ID" and v0.dive_id = v1.dive_id),
v3 as (select *, min(case when i < pk and v > crit then i end) over (partition by "ID", dive_id) began from v2),
v4 as (select *, case when i < pk and i > began then 1 when i > pk then 2 else 0 end side from v3),
v5 as (select *, side * 2 + coalesce(case side when 1 then v <= crit when 2 then v < -crit end, false)::int key from v4),
v6 as (select *, sum(case when key = pkey then 0 else 1 end) over (partition by "ID", dive_id order by us) st from (select *, lag(key) over (partition by "ID", dive_id order by us) pkey from v5)),
v7 as (select *, key in (3, 5) and count(*) over (partition by "ID", dive_id, st) >= len held from v6),
v8 as (select *, case when began is not null and pk - 1 >= len then coalesce(min(case when held and key = 3 then i end) over (partition by "ID", dive_id), pk) - 1 end dto, case when m - pk >= len then min(case when held and key = 5 then i end) over (partition by "ID", dive_id) end ufr from v7),
ph as (select p.record_id, p.dive_id, case when p.dive_id = 0 then 'inter_dive' when m >= 3 and crit > 0 and i <= dto then 'descent' when m >= 3 and crit > 0 and i >= ufr then 'ascent' else 'bottom' end dive_phase from p left join v8 on p.record_id = v8.record_id)"""

_NO_SHAPE = "((ds > 0)::int + (bs > 0)::int + (as_ > 0)::int < 2)"
#: The dive table (records here have a depth in every row, so only time steps interrupt).
DIVE_METRICS = f"""x0 as (select dv.*, ph.dive_phase f, case when pid = dv.dive_id then dz0 end dz, case when pid = dv.dive_id then dt end ind, row_number() over (partition by "ID", dv.dive_id order by us) i from dv join ph on dv.record_id = ph.record_id where dv.dive_id > 0),
x1 as (select *, dz / nullif(ind, 0) v from x0),
tz as (select "ID", dive_id, list_reduce(list_transform(list(depth order by us), lambda d: {{'n': 0, 'l': d, 'w': 0}}), lambda a, b: case when abs(b.l - a.l) >= 0.5 then {{'n': a.n + case when a.w <> 0 and sign(b.l - a.l)::int <> a.w then 1 else 0 end, 'l': b.l, 'w': sign(b.l - a.l)::int}} else a end).n reversals from x1 group by "ID", dive_id),
x2 as (select "ID", dive_id, avg(depth) mean_depth, stddev_samp(depth) sd_depth, max(abs(depth)) amplitude, max(abs(depth)) - greatest(arg_min(abs(depth), us), arg_max(abs(depth), us)) prominence, count(*) n,
{", ".join(f"case when count(*) filter (f = '{f}') >= 2 then max(t) filter (f = '{f}') - min(t) filter (f = '{f}') else 0 end {a}" for f, a in (("descent", "ds"), ("bottom", "bs"), ("ascent", "as_")))},
{", ".join(f"avg(v) filter (f = '{f}') {a}r, quantile_cont(abs(v), 0.9) filter (f = '{f}') {a}q" for f, a in (("descent", "d"), ("ascent", "a")))}, avg(depth) filter (f = 'bottom') bm, stddev_samp(depth) filter (f = 'bottom') bsd, coalesce(sum(abs(dz)), 0) vertical_m, avg(temp) temp_mean, stddev_samp(temp) temp_sd,
coalesce(max(case when i = 1 and dt > 600 then dt end), 0) e0 from x1 group by "ID", dive_id),
x3 as (select x2.*, tz.reversals, dt1.* exclude ("ID", dive_id), e0 + case when behind > 600 then behind else 0 end gap_s, (e0 > 0)::int + coalesce(behind > 600, false)::int n_gaps, (ts or te)::int + (e0 > 0 or coalesce(behind > 600, false))::int kinds from x2 join dt1 on x2."ID" = dt1."ID" and x2.dive_id = dt1.dive_id join tz on x2."ID" = tz."ID" and x2.dive_id = tz.dive_id)
select "ID", dive_id, {q("s")} "start", {q("e")} "end", {q("duration_s")} duration_s, {q("max_depth")} max_depth, {q("mean_depth")} mean_depth, {q("sd_depth")} sd_depth, 0.0::double baseline, {q("amplitude")} amplitude, {q("prominence")} prominence, n, 1.0::double coverage,
{", ".join(f"case when not {_NO_SHAPE} then {q(a)} end {b}" for a, b in (("ds", "descent_s"), ("bs", "bottom_s"), ("as_", "ascent_s"), ("dr", "descent_rate"), ("dq", "descent_rate_q90"), ("ar", "ascent_rate"), ("aq", "ascent_rate_q90")))}, {", ".join(f"case when not {_NO_SHAPE} and bs > 0 then {q(a)} end {b}" for a, b in (("bm", "bottom_mean"), ("bsd", "bottom_sd")))},
{q("vertical_m")} vertical_m, case when not {_NO_SHAPE} then reversals end reversals, ts truncated_start, te truncated_end, n_gaps, {q("gap_s")} gap_s, case when kinds > 1 then 'mixed' when ts or te then 'boundary' when kinds = 1 then 'time_gap' else 'none' end censored, kinds = 0 complete,
case when ds > 0 or bs > 0 or as_ > 0 then case when ds > 0 then 'D' else '' end || case when bs > 0 then 'B' else '' end || case when as_ > 0 then 'A' else '' end else 'X' end phase_structure, not {_NO_SHAPE} shape_supported, {q("inter_dive_s")} inter_dive_s, inter_dive_censored, {q("temp_mean")} temp_mean, {q("temp_sd")} temp_sd from x3"""

SQL["div3_settings"] = f"""with {TAG}, s as (select "ID", depth, t - lag(t) over w dt, depth - 2 * lag(depth) over w + lag(depth, 2) over w bend from tag window w as (partition by "ID" order by us)),
m as (select "ID", median(case when dt > 0 then dt end) dt, median(bend) mid, quantile_cont(case when depth < 2 then abs(depth) end, 0.95) residual from s group by "ID"),
n as (select s."ID", 1.4826 * median(abs(bend - mid)) / sqrt(6) noise from s join m on s."ID" = m."ID" group by s."ID"),
a as (select max(residual) r, max(noise) n, max(dt) dt from m left join n on m."ID" = n."ID"),
c as (select *, greatest(case when r <> 0 then 3 * r else 3 * 0.34 end, 1) threshold, coalesce(n, 0) noise, coalesce(nullif(dt, 0), 1) step from a),
b as (select *, greatest(case when r <> 0 then 2 * r else 0.5 end, threshold / 10, 0.5) band0 from c), d as (select *, case when band0 >= threshold then threshold / 2 else band0 end band from b)
select {q("threshold")} threshold, {q("band")} band, {q("threshold - band")} min_amplitude, {q("greatest(4, 4 * step, 10)")} min_duration_s, {q("greatest(60, 10 * step)")} max_gap_s, {q("greatest(0.5, 3 * noise)")} wiggle from d"""

# Tracks


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"2 * 6371.0 * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0)))"


_BEARING = "((degrees(atan2(sin(radians(lon - x)) * cos(radians(lat)), cos(radians(y)) * sin(radians(lat)) - sin(radians(y)) * cos(radians(lat)) * cos(radians(lon - x)))) % 360) + 360) % 360"
_TORT = """t{n} as (select "ID", avg(t) tortuosity from (select "ID", case when {net} <> 0 then (s - coalesce(li, 0)) / ({net}) end t from (select "ID", floor(us / {us}) b, count(*) n, sum(step) s, arg_min(lon, us) ax, arg_min(lat, us) ay, arg_max(lon, us) zx, arg_max(lat, us) zy, arg_min_null(step, us) li from l group by all) where n >= 3) group by "ID")"""
SQL["agg16_track_metrics"] = f"""with f as (select "ID", epoch_us(datetime) us, lon, lat, row_number() over (partition by "ID", datetime order by pos_id) n from positions where datetime is not null and not coalesce(isnan(lon), false)),
p as (select "ID", us, lon, lat, lag(lon) over w x, lag(lat) over w y from f where n = 1 and lon is not null and lat is not null window w as (partition by "ID" order by us)),
l0 as (select *, {hav("x", "y", "lon", "lat")} step, {_BEARING} course from p), l as (select *, (((course - lag(course) over (partition by "ID" order by us) + 180) % 360) + 360) % 360 - 180 turn from l0),
e as (select "ID", count(*) points, (max(us) - min(us)) / 3.6e9 hrs, coalesce(sum(step), 0) path, arg_min(lon, us) ax, arg_min(lat, us) ay, arg_max(lon, us) zx, arg_max(lat, us) zy, stddev_samp(radians(turn)) sd, avg(step) st, avg(abs(turn)) mt from l group by "ID"),
{_TORT.format(n=1, us=3_600_000_000, net=hav("ax", "ay", "zx", "zy"))}, {_TORT.format(n=2, us=86_400_000_000, net=hav("ax", "ay", "zx", "zy"))},
x as (select e.*, {hav("ax", "ay", "zx", "zy")} net from e)
select x."ID", points, round(hrs, 3) + 0.0 "hours", round(path, 3) + 0.0 path_km, round(net, 3) + 0.0 net_km, round(case when points >= 3 and path <> 0 then net / path end, 3) + 0.0 straightness, round(case when points >= 3 and st <> 0 then 1.18 * sd / sqrt(st) end, 3) + 0.0 sinuosity, round(case when points >= 3 then mt end, 3) + 0.0 mean_turn,
round(t1.tortuosity, 3) + 0.0 tortuosity_hourly, round(t2.tortuosity, 3) + 0.0 tortuosity_daily from x left join t1 on x."ID" = t1."ID" left join t2 on x."ID" = t2."ID" """

# Orientation and calibration

SQL["flt13_static"] = f"""with {TAGU}, s as (select record_id, "ID", us, coalesce(abs(sqrt(ax*ax + ay*ay + az*az) - 1) < 0.1, false) s from tag), w as (select record_id, sum(s::int) over (partition by "ID" order by us rows between 2 preceding and 2 following) n from s) select record_id from w where n = 5"""
_IRON = """o as (select * from tag where mx is not null and my is not null and mz is not null), c as (select "ID", count(*) n, (quantile_cont(mx, 0.02) + quantile_cont(mx, 0.98)) / 2 cx, (quantile_cont(my, 0.02) + quantile_cont(my, 0.98)) / 2 cy, (quantile_cont(mz, 0.02) + quantile_cont(mz, 0.98)) / 2 cz from o group by "ID" having count(*) >= 100)"""
SQL["mag4_coverage"] = f"""with {TAGU}, {_IRON}, d as (select o."ID", mx - cx x, my - cy y, mz - cz z from o join c on o."ID" = c."ID"), e as (select "ID", x, y, z, sqrt(x*x + y*y + z*z) r from d),
g as (select "ID", least(floor((atan2(y, x) + pi()) / (2 * pi()) * 12), 11) * 6 + least(floor((case when r <> 0 then z / r end + 1) / 2 * 6), 5) k from e)
select "ID", count(distinct k) cells, {q("count(distinct k) / 72")} coverage from g group by "ID" """
SQL["prj9_calibrated"] = f"""with {TAGU}, {_IRON}, r as (select t."ID", sqrt(pow(mx - coalesce(cx, 0), 2) + pow(my - coalesce(cy, 0), 2) + pow(mz - coalesce(cz, 0), 2)) r from tag t left join c on t."ID" = c."ID"), s as (select "ID", case when median(r) <> 0 then stddev_samp(r) / median(r) end v from r group by "ID")
select "ID", {q("v")} radius_cv, case when v < 0.05 then 'high' when v < 0.15 then 'medium' else 'low' end confidence from s"""

# Features: headings as in the other feature queries

HEADED = """p as (select *, degrees(atan2(-ax, sqrt(ay*ay + az*az))) pitch, degrees(atan2(ay, az)) roll from tag), h0 as (select *, mx * cos(radians(pitch)) + my * sin(radians(pitch)) * sin(radians(roll)) + mz * sin(radians(pitch)) * cos(radians(roll)) xh, my * cos(radians(roll)) - mz * sin(radians(roll)) yh from p),
h as (select * exclude (xh, yh), case when abs(pitch) <= 89.5 then ((degrees(atan2(-yh, xh)) + 5.0) % 360 + 360) % 360 end heading from h0)"""


def wrap(x: str) -> str:
    return f"(((({x}) + 180) % 360 + 360) % 360 - 180)"


_C5 = "c as (partition by \"ID\" order by us rows between 2 preceding and 2 following), o as (partition by \"ID\" order by us)"
SQL["fea3_circular"] = f"""with {TAG}, {HEADED}, w as (select "ID", us, heading, count(*) over c n, avg(sin(radians(heading))) over c s, avg(cos(radians(heading))) over c k, list(heading) over c l, quantile_cont(heading, 0.75) over c q3, quantile_cont(heading, 0.25) over c q1 from h where heading is not null window {_C5}),
v as (select *, list_sort(list_transform(l, lambda x: (x % 360 + 360) % 360)) z, ((degrees(atan2(s, k)) + 180) % 360 + 360) % 360 a from w where n = 5),
t as (select *, list_sort(list_transform(z, lambda e1: {{'d': round(list_sum(list_transform(z, lambda e2: abs(((e2 - e1 + 180) % 360 + 360) % 360 - 180))), 9), 'v': e1}}))[1].v med, list_max([z[2] - z[1], z[3] - z[2], z[4] - z[3], z[5] - z[4], z[1] + 360 - z[5]]) gap from v)
select "ID", us datetime, round(case when a > 360 - 1e-8 then 0 else a end - 180, 4) + 0.0 mean, round(((med + 180) % 360 + 360) % 360 - 180, 4) + 0.0 median, round(degrees(sqrt(-2 * ln(least(sqrt(s*s + k*k), 1)))), 4) + 0.0 sd, round(360 - gap, 4) + 0.0 "range", round(abs({wrap("q3 - q1")}), 4) + 0.0 iqr from t"""

SQL["fea4_enhanced"] = f"""with {TAG}, {HEADED}, d as (select "ID", us, depth, heading, {wrap("heading - lag(heading) over o")} dh, depth - lag(depth) over o dx, avg(depth) over c m, count(*) over c n, list(depth) over c l from h where depth is not null and heading is not null window {_C5}),
e as (select *, dx - lag(dx) over (partition by "ID" order by us) ddx, list_filter(list_transform(l, lambda v: sign(round(v - m, 9))), lambda v: v <> 0) sg, list_transform(l, lambda v: v - m) aw from d),
f as (select *, sum(abs(dh)) over c cum, avg(sin(radians(heading))) over c s, avg(cos(radians(heading))) over c k, {wrap("lead(heading, 2) over o - lag(heading, 2) over o")} nc, {wrap("last_value(heading) over c - first_value(heading) over c")} fl, avg(ddx * ddx) over c sm, avg(dx * dx) over c jk, stddev_samp(m) over c sdm, avg(m) over c mm, avg(abs(dh)) over c tm, stddev_samp(abs(dh)) over c tsd,
  list_sum(list_transform(range(1, len(sg)), lambda i: case when sg[i] <> sg[i + 1] then 1 else 0 end)) cr, list_sum(list_transform(aw, lambda v: v * v)) sq, list_sum(list_transform(range(1, len(aw)), lambda i: aw[i] * aw[i + 1])) pr from e window {_C5})
select "ID", us datetime, {q("case when n = 5 then abs(nc) end")} net_change, {q("case when n = 5 then cum end")} cumulative_change, {q("1 - sqrt(s*s + k*k)")} variance, case when abs(fl) > 120 then 1 else 0 end uturn, {q("case when n = 5 then sqrt(sm) end")} smoothness, {q("case when n = 5 then sqrt(jk) end")} jerk,
{q("case when n = 5 then sdm / (abs(mm) + 0.001) end")} predictability, {q("case when n = 5 then coalesce(cr, 0) / 5 end")} zero_crossings, {q("case when tm = 0 then 0 else tsd / tm end")} turning_variability, {q("case when n = 5 then cum / (abs(fl) + 1) end")} circling, {q("case when n = 5 and sq > 1e-12 then pr / sq end")} autocorrelation from f"""

_CW = '(partition by "ID" order by us rows between 9 preceding and 10 following)'
SQL["fea8_rhythms"] = f"""with {TAG}, {HEADED}, d0 as (select "ID", us, depth, heading, {wrap("heading - lag(heading) over o")} st, abs(depth - lag(depth) over o) d, case when count(*) over c = 5 then stddev_samp(depth) over c end sd, row_number() over o i, count(*) over (partition by "ID") n from h where depth is not null and heading is not null window {_C5}),
d1 as (select *, sum(coalesce(st, heading)) over (partition by "ID" order by us) hu from d0),
d2 as (select *, count(*) over {_CW} m, list(hu) over {_CW} hs, list(depth) over {_CW} xs, case when count(*) over {_CW} = 20 and count(d) over {_CW} * 2 >= 20 then case when avg(d) over {_CW} = 0 then 0 else stddev_samp(d) over {_CW} / avg(d) over {_CW} end end dv, case when count(*) over {_CW} = 20 and count(sd) over {_CW} * 2 >= 20 then stddev_samp(sd) over {_CW} / (avg(sd) over {_CW} + 0.001) end sv from d1),
d3 as (select *, case when i < 10 then max(case when i = 10 then dv end) over (partition by "ID") when i > n - 10 then max(case when i = n - 10 then dv end) over (partition by "ID") else dv end dc, case when i < 10 then max(case when i = 10 then sv end) over (partition by "ID") when i > n - 10 then max(case when i = n - 10 then sv end) over (partition by "ID") else sv end mc,
  list_transform(hs, lambda v: v - list_avg(hs)) aw, case when m = 20 then list_transform(range(1, 21), lambda j: round((xs[greatest(least(j, 19), 2) - 1] + xs[greatest(least(j, 19), 2)] + xs[greatest(least(j, 19), 2) + 1]) / 3, 9)) end sm from d2),
d4 as (select *, list_sum(list_transform(aw, lambda v: v * v)) tot, list_filter(range(2, 20), lambda j: sm[j] > sm[j - 1] and sm[j] > sm[j + 1]) pk from d3),
d5 as (select *, {" + ".join(f"case when floor(m / 4) >= {g} then list_sum(list_transform(range(1, m - {g} + 1), lambda j: aw[j] * aw[j + {g}])) else 0 end" for g in range(1, 6))} ac, case when sm is not null and len(pk) >= 3 then list_transform(range(1, len(pk)), lambda j: (pk[j + 1] - pk[j])::double) end iv from d4)
select "ID", us datetime, {q("case when m >= 10 and tot > 1e-12 then ac / least(5, floor(m / 4)) / tot end")} heading_autocorr_avg, {q("list_stddev_samp(iv) / list_avg(iv)")} oscillation_regularity, {q("mc")} movement_consistency, {q("d")} depth_change_rate, {q("dc")} depth_change_consistency from d5"""

SQL["fea5_stability"] = f"""with {TAG}, {HEADED}, d as (select *, abs(pitch - lag(pitch) over o) + abs(roll - lag(roll) over o) + abs({wrap("heading - lag(heading) over o")}) c0 from h window o as (partition by "ID" order by us))
select "ID", us datetime, {q("case when count(*) over c = 5 then 1 / (1 + stddev_samp(pitch) over c + stddev_samp(roll) over c) end")} posture_stability, {q("case when count(*) over c = 5 then avg(c0) over c end")} activity_index from d window {_C5}"""

SQL["fea6_distribution_shape"] = f"""with {TAG}, w as (select "ID", us, count(*) over c n, list(temp) over c l, min(temp) over c lo, max(temp) over c hi from tag where temp is not null window c as (partition by "ID" order by us rows between 4 preceding and 5 following)),
e as (select "ID", us, unnest(l) v, lo, hi from w where n = 10),
m as (select "ID", us, avg(v) a, median(v) md, any_value(lo) lo, any_value(hi) hi, ceil(log2(10) + 1) k from e group by "ID", us),
f as (select e."ID", e.us, m.lo, m.hi, v, v - a d, abs(v - md) ad, least(floor((v - m.lo) / nullif((m.hi - m.lo) / k, 0)), k - 1) b from e join m on e."ID" = m."ID" and e.us = m.us),
g as (select "ID", us, any_value(lo) lo, any_value(hi) hi, 1.4826 * median(ad) mad, avg(d * d) m2, avg(d * d * d) m3, avg(d * d * d * d) m4 from f group by "ID", us),
h as (select "ID", us, -sum(c / 10 * ln(c / 10)) ent from (select "ID", us, b, count(*) c from f where hi > lo group by all) group by "ID", us)
select g."ID", g.us datetime, {q("mad")} temp_mad_10s, {q("ent")} temp_entropy_10s, {q("m3 / pow(m2, 1.5)")} temp_skewness_10s, round(m4 / (m2 * m2) + 3e-8, 6) + 0.0 temp_kurtosis_10s, {q("hi - lo")} temp_range_10s from g join h on g."ID" = h."ID" and g.us = h.us where hi > lo"""

_PICK = """r{n} as (select * from (select *, row_number() over (partition by "ID" order by x desc, us) k from c{p}) where k = 1), c{n} as (select c.* from c{p} c join r{n} r on c."ID" = r."ID" where abs(c.us - r.us) >= 20000000)"""
SQL["srt4_top_segments"] = f"""with {TAG}, c0 as (select "ID", us, x from (select "ID", us, abs(avg(depth) over (partition by "ID" order by us rows between 9 preceding and 10 following)) x from tag where depth is not null)),
{", ".join(_PICK.format(n=n, p=n - 1) for n in range(1, 6))}
{" union all ".join(f'select "ID", us datetime, {q("x")} intensity, {n}::bigint "rank" from r{n}' for n in range(1, 6))}"""

# The record in motion: means per second, or the record's own rows where it is slower

_MOVING = f"""{TAGU}, {HEADED}, hz as (select "ID", min(us) t0, median(case when dt > 0 then dt end) dt from (select "ID", us, t - lag(t) over (partition by "ID" order by us) dt from h) group by "ID"),
ow as (select *, coalesce(case when 1 / dt < 1 then 1 / dt else round(1 / dt) end <= 1, true) own from hz),
bn as (select h.*, own, t0, case when own then us - t0 else floor((us - t0) / 1e6)::bigint end b from h join ow on h."ID" = ow."ID"),
mb as (select "ID", t0 + case when own then b else b * 1000000 end us, avg(depth) depth, avg(pitch) pitch, avg(sin(radians(heading))) hs, avg(cos(radians(heading))) hc from bn group by "ID", t0, own, b),
mv as (select "ID", us, us / 1e6 t, depth, pitch, case when (degrees(atan2(hs, hc)) % 360 + 360) % 360 > 360 - 1e-8 then 0 else (degrees(atan2(hs, hc)) % 360 + 360) % 360 end heading from mb)"""
_RECKONED = f"""{_MOVING}, home as (select "ID", min(lon) lon0, min(lat) lat0 from deployments group by "ID"),
r0 as (select mv.*, lon0, lat0, t - lag(t) over (partition by mv."ID" order by us) dt, row_number() over (partition by mv."ID" order by us) rn from mv join home on mv."ID" = home."ID"),
r1 as (select "ID", median(case when dt > 0 then dt end) usual from r0 group by "ID"),
r2 as (select r0.*, 0.5 * cos(radians(pitch)) * case when rn = 1 then 0 when dt > 0 then dt else usual end flat from r0 join r1 on r0."ID" = r1."ID"),
r3 as (select *, coalesce(flat * sin(radians(heading)), 0) e, sum(coalesce(flat * cos(radians(heading)), 0)) over (partition by "ID" order by us) north from r2),
r4 as (select *, lat0 + degrees(north / 6371000.0) la from r3),
r5 as (select *, lon0 + sum(degrees(e / (6371000.0 * cos(radians(la))))) over (partition by "ID" order by us) lo from r4),
dr as (select "ID", us, radians(lo - lon0) * 6371000.0 * cos(radians(lat0)) east_m, radians(la - lat0) * 6371000.0 north_m from r5)"""
SQL["trk3_reckoned"] = f"with {_RECKONED} select \"ID\", us datetime, 0.5::double speed_dr, round(east_m, 3) + 0.0 east_m, round(north_m, 3) + 0.0 north_m from dr"
SQL["trk9_directedness"] = f"""with {_RECKONED}, st as (select *, sqrt(pow(east_m - lag(east_m) over w, 2) + pow(north_m - lag(north_m) over w, 2)) s from dr window w as (partition by "ID" order by us)),
e as (select "ID", sum(case when east_m is not null then coalesce(s, 0) end) path, sqrt(pow(arg_max(east_m, us) - arg_min(east_m, us), 2) + pow(arg_max(north_m, us) - arg_min(north_m, us), 2)) net from st group by "ID")
select "ID", round(path, 2) + 0.0 path_m, round(net, 2) + 0.0 net_m, round(case when path <> 0 then net / path end, 6) + 0.0 directedness from e"""

_ANCHORED = f"""{_RECKONED}, dp as (select *, sum(coalesce(sqrt(pow(east_m - e0, 2) + pow(north_m - n0, 2)), 0)) over (partition by "ID" order by us) path from (select *, lag(east_m) over w e0, lag(north_m) over w n0 from dr window w as (partition by "ID" order by us))),
sp as (select dp."ID", min(us) a, max(us) z, any_value(lon0) lon0, any_value(lat0) lat0 from dp join home on dp."ID" = home."ID" group by dp."ID"),
an0 as (select "ID", a us, 1 o, 50.0::double r, 0.0::double e, 0.0::double n, 'Deploy' q from sp union all
  select p."ID", epoch_us(datetime), 3, case when type = 'FastGPS' then 50.0::double else case quality when '3' then 250.0::double when '2' then 500.0::double when '1' then 1500.0::double when '0' then 3000.0::double when 'A' then 5000.0::double when 'B' then 10000.0::double when 'Z' then 50000.0::double else 1500.0::double end end,
    radians(lon - lon0) * 6371000.0 * cos(radians(lat0)), radians(lat - lat0) * 6371000.0, case when type = 'FastGPS' then type else quality end
  from positions p join sp on p."ID" = sp."ID" where datetime is not null and type <> 'User' and lon is not null and lat is not null and epoch_us(datetime) between a and z),
an1 as (select * from (select *, row_number() over (partition by "ID", us order by o, r, e, n) k from an0) where k = 1),
an as (select a1."ID", a1.us, a1.r, a1.e, a1.n, a1.q, d.east_m, d.north_m, d.path from an1 a1 asof join dp d on a1."ID" = d."ID" and a1.us <= d.us)"""
#: The offset is carried from anchor to anchor by a gain: a recursion over each record's anchors.
SQL["trk10_cross_validation"] = f"""with recursive {_ANCHORED}, nb as (select *, row_number() over w k, count(*) over (partition by "ID") many, lag(us) over w us0, lead(us) over w us1, lag(path) over w p0, lead(path) over w p1, lead(e) over w e1, lead(n) over w n1, lead(r) over w r1, lead(east_m) over w x1, lead(north_m) over w y1 from an window w as (partition by "ID" order by us)),
ga as (select *, pow(0.5 * (us - us0) / 1e6, 2) d2, pow(0.5 * (us1 - us0) / 1e6, 2) w2 from nb),
ca as (select "ID", k, 0.0::double ce, 0.0::double cn from ga where k = 1 union all select ga."ID", ga.k, ce + (d2 / (d2 + r * r)) * (e - east_m - ce), cn + (d2 / (d2 + r * r)) * (n - north_m - cn) from ca join ga on ga."ID" = ca."ID" and ga.k = ca.k + 1),
ha as (select ga.*, ca.ce, ca.cn, case when us1 is null then 0 else w2 / (w2 + r1 * r1) * case when p1 - p0 > 1e-6 then (path - p0) / (p1 - p0) else (us - us0) / (us1 - us0) end end f from ga join ca on ga."ID" = ca."ID" and ga.k = ca.k + 1 where q is distinct from 'Deploy'),
ia as (select ha.*, lon0, lat0, east_m + ce + f * coalesce(e1 - x1 - ce, 0) pe, north_m + cn + f * coalesce(n1 - y1 - cn, 0) pn from ha join sp on ha."ID" = sp."ID"),
ja as (select *, lon0 + degrees(pe / (6371000.0 * cos(radians(lat0)))) lo1, lat0 + degrees(pn / 6371000.0) la1, lon0 + degrees(e / (6371000.0 * cos(radians(lat0)))) lo2, lat0 + degrees(n / 6371000.0) la2 from ia)
select "ID", us datetime, q quality, round(1000 * {hav("lo1", "la1", "lo2", "la2")}, 1) + 0.0 error_m, {q("least(us - us0, coalesce(us1 - us, us - us0)) / 3.6e9")} gap_h, us1 is not null interpolated, r::double fix_radius_m, many - 1 n_anchors_used, 'constant' speed_method, 'error_weighted' vpc_method from ja"""


def _over_seconds(x: str, name: str, s: float) -> str:
    """Mean over `s` seconds: NULL where a value is missing in the frame, and where the frame leaves the record."""
    half = round(s * 500_000)
    frame = f'(partition by "ID" order by us range between {half - 1} preceding and {half} following)'
    k = f"greatest(coalesce(round(rate * {s}), 1), 1)"
    return f"case when row_number() over w - 1 >= floor(({k} - 1) / 2) and count(*) over (partition by \"ID\") - row_number() over w >= floor({k} / 2) and count({x}) over {frame} = count(*) over {frame} then avg({x}) over {frame} end {name}"


SQL["k12_mount_offsets"] = f"""with {TAGU}, {HEADED}, rt as (select "ID", 1e6 / median(case when dt > 0 then dt end) rate from (select "ID", us - lag(us) over (partition by "ID" order by us) dt from h) group by "ID"),
v0 as (select h.*, rate from h join rt on h."ID" = rt."ID"), v1 as (select *, {_over_seconds("depth", "z", 10.0)} from v0 window w as (partition by "ID" order by us)),
v2 as (select *, 1e6 * (coalesce(lead(z) over w, z) - coalesce(lag(z) over w, z)) / nullif(coalesce(lead(us) over w, us) - coalesce(lag(us) over w, us), 0) vv0 from v1 window w as (partition by "ID" order by us)),
v3 as (select *, {_over_seconds("vv0", "vv1", 1.0)} from v2 window w as (partition by "ID" order by us)), v4 as (select *, {_over_seconds("vv1", "vv", 10.0)} from v3 window w as (partition by "ID" order by us)),
f as (select "ID", count(*) filter (pitch is not null and vv is not null) n, stddev_samp(vv) filter (pitch is not null) sd, regr_intercept(pitch, vv) b, regr_r2(pitch, vv) r2, median(abs(vv)) still from v4 group by "ID"),
rl as (select v4."ID", median(roll) r from v4 join f on v4."ID" = f."ID" where abs(vv) <= still group by v4."ID")
select f."ID", round(case when n >= 100 and sd >= 1e-6 and r2 >= 0.1 and abs(b) < 45 then b else 0 end, 6) + 0.0 pitch_offset, round(case when abs(r) < 60 then r else 0 end, 6) + 0.0 roll_offset from f left join rl on f."ID" = rl."ID" """

# The sun (low-accuracy formulae): declination and equation of time at a time, hour angle, refined once


def _sun(t: str, source: str, out: str) -> str:
    return f"""{out}a as (select *, ({t} / 86400 + 2440587.5 - 2451545.0) / 36525.0 c from {source}),
{out}b as (select *, radians((280.46646 + c * (36000.76983 + c * 0.0003032)) % 360) l, radians(357.52911 + c * (35999.05029 - c * 0.0001537)) m, 0.016708634 - c * (0.000042037 + c * 0.0000001267) ecc, radians(125.04 - 1934.136 * c) om from {out}a),
{out}c as (select *, l + radians(sin(m) * (1.914602 - c * (0.004817 + c * 0.000014)) + sin(2 * m) * (0.019993 - c * 0.000101) + sin(3 * m) * 0.000289 - 0.00569 - 0.00478 * sin(om)) ap, radians(23.0 + (26.0 + (21.448 - c * (46.815 + c * (0.00059 - c * 0.001813))) / 60) / 60 + 0.00256 * cos(om)) tl from {out}b),
{out}d as (select *, asin(sin(tl) * sin(ap)) de, pow(tan(tl / 2), 2) y from {out}c),
{out}e as (select *, 4 * degrees(y * sin(2 * l) - 2 * ecc * sin(m) + 4 * ecc * y * sin(m) * cos(2 * l) - 0.5 * y * y * sin(4 * l) - 1.25 * ecc * ecc * sin(2 * m)) eqt, (cos(radians(90 + depr)) - sin(radians(lat)) * sin(de)) / (cos(radians(lat)) * cos(de)) ch from {out}d),
{out} as (select pos_id, ev, depr, sgn, day, lon, lat, day * 86400 + 60 * (720 - 4 * lon - eqt + sgn * 4 * case when abs(ch) <= 1 then degrees(acos(ch)) end) t from {out}e)"""


SQL["fun_diel_phase"] = f"""with p as (select pos_id, epoch_us(datetime) / 1e6 s, case when not isnan(lon) then lon end lon, case when not isnan(lat) then lat end lat from positions),
q as (select *, floor((s + 240 * lon) / 86400) day0 from p),
ev as (select pos_id, v.ev, v.depr, v.sgn, day0 + v.off as day, lon, lat, (day0 + v.off) * 86400 + 43200 - 240 * lon t from q, (values ('rise', 0.833, -1, 0), ('fall', 0.833, 1, 0), ('dawn', 18.0, -1, 0), ('dusk', 18.0, 1, 0), ('late', 18.0, 1, -1)) v(ev, depr, sgn, off) where s is not null and lon is not null and lat is not null),
{_sun("t", "ev", "x1")}, {_sun("t", "x1", "x2")},
e as (select pos_id, {", ".join(f"max(case when ev = '{k}' then t end) {k}" for k in ("rise", "fall", "dawn", "dusk", "late"))} from x2 group by pos_id),
f as (select q.pos_id, s, e.* exclude (pos_id) from q left join e on q.pos_id = e.pos_id)
select pos_id, case when rise is null or fall is null then null when s >= rise and s < fall then 'day' else 'night' end phase2,
{", ".join(f"case when rise is null or fall is null or dawn is null or dusk is null or late is null then null when s >= rise and s < fall then 'day' when s >= dusk or (s < dawn and s >= late) then 'night' else {between} end phase{n}" for n, between in ((3, "'twilight'"), (4, "case when s < rise then 'dawn' else 'dusk' end")))} from f"""


# Steps of the pivot, each on headings from raw acceleration

_RATED = f"""{TAGU}, {HEADED}, rt as (select "ID", 1e6 / median(case when dt > 0 then dt end) rate from (select "ID", us - lag(us) over (partition by "ID" order by us) dt from h) group by "ID"), v0 as (select h.*, rate from h join rt on h."ID" = rt."ID")"""
SQL["k9_vertical_velocity"] = f"""with {_RATED}, v1 as (select *, {_over_seconds("depth", "z", 10.0)} from v0 window w as (partition by "ID" order by us)),
v2 as (select *, 1e6 * (coalesce(lead(z) over w, z) - coalesce(lag(z) over w, z)) / nullif(coalesce(lead(us) over w, us) - coalesce(lag(us) over w, us), 0) vv0 from v1 window w as (partition by "ID" order by us)), v3 as (select *, {_over_seconds("vv0", "vv", 1.0)} from v2 window w as (partition by "ID" order by us)) select record_id, {q("vv")} vertical_velocity from v3"""
SQL["k7_jerk"] = f"""with {TAGU}, d as (select record_id, {", ".join(f"a{a} - lag(a{a}) over w d{a}" for a in "xyz")}, t - lag(t) over w dt from tag window w as (partition by "ID" order by us)) select record_id, {q4("case when dt <> 0 then sqrt(dx*dx + dy*dy + dz*dz) / dt end")} jerk from d"""
SQL["k6_burst"] = f"""with {TAGU}, v as (select record_id, "ID", abs(sqrt(ax*ax + ay*ay + az*az) - 1) v from tag), l as (select "ID", quantile_cont(v, 0.95) l from v group by "ID") select record_id, coalesce(v >= l, false) burst from v join l on v."ID" = l."ID" """
SQL["k13_offsets_taken_off"] = f"""with {TAGU}, {HEADED} select record_id, {q("pitch - case when h.\"ID\" like 'C%' then 4.5 else 0 end")} pitch, {q(wrap("roll - case when h.\"ID\" like 'C%' then 170.0 else 0 end"))} roll from h"""


def _circle(x: str, name: str, low: int, frame: str) -> str:
    a = f"(((degrees(atan2(avg(sin(radians({x}))) over {frame}, avg(cos(radians({x}))) over {frame})) - ({low})) % 360 + 360) % 360)"
    return f"{q(f'case when {a} > 360 - 1e-8 then 0 else {a} end + ({low})')} {name}"


_TENS = '(partition by "ID" order by us range between 29999999 preceding and 30000000 following)'
SQL["k14_smoothed_orientation"] = f"""with {_RATED}, s as (select record_id, {_circle("roll", "roll", -180, _TENS)}, {_circle("heading", "heading", 0, _TENS)}, {_over_seconds("pitch", "pitch0", 60.0)} from v0 window w as (partition by "ID" order by us)) select record_id, roll, heading, {q("pitch0")} pitch from s"""
SQL["flt11_anomalous_mounting"] = f"""with {TAGU}, {HEADED}, m as (select "ID", median(pitch) p, median(roll) r from h group by "ID") select "ID", {q("p")} pitch_median, {q("r")} roll_median, abs(p) > 45 or abs(r) > 45 flag from m"""
SQL["flt4_plain_tests"] = f"""with home as (select "ID", min(lon) lo, min(lat) la from deployments where "ID" is not null group by "ID")
select pos_id, case when type in ('FastGPS', 'Argos') and coalesce(type = 'FastGPS' and try_cast(quality as int) < 4, false) then 'satellites' when type in ('FastGPS', 'Argos') and coalesce({hav("lo", "la", "lon", "lat")} > 500, false) then 'distance' end removed
from positions p left join home on p."ID" = home."ID" where p."ID" is not null and datetime is not null and lon is not null and lat is not null and not isnan(lon) and not isnan(lat)"""
