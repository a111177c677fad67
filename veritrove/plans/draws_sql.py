"""DuckDB SQL of the standard library's seeded draws, so that bootstrap intervals have an oracle."""

from __future__ import annotations

_MIX = lambda y, z: f"(({y} & 2147483648) | ({z} & 2147483647)) >> 1"
_STEP = lambda word, y, z: f"xor(xor({word}, {_MIX(y, z)}), ({z} & 1) * 2567483615)"


def outputs(count: str) -> str:
    """CTEs up to outputs(i, w): the 32-bit outputs of random.Random(0), `count` of them at least. They need `with recursive`."""
    part = lambda a, b, word: f"list_transform(range({a}, {b}), lambda i: {_STEP(word, 's[i + 1]', 's[i + 2]')})"
    return f"""
seed0(i, v) as (select 0, 19650218::ubigint union all select i + 1, (1812433253::ubigint * xor(v, v >> 30) + i + 1) & 4294967295 from seed0 where i < 623),
seed1 as (select list(v order by i) s from seed0),
seed2(i, v) as (select 0, 19650218::ubigint union all select i + 1, xor(s[i + 2], (xor(v, v >> 30) * 1664525) & 4294967295) from seed2, seed1 where i < 623),
seed3 as (select list(v order by i) s from seed2),
seed4(i, v) as (select 1, xor(s[2], (xor(s[624], s[624] >> 30) * 1664525) & 4294967295) from seed3 union all
  select i + 1, (xor(s[i + 2], (xor(v, v >> 30) * 1566083941) & 4294967295) + 4294967296 - (i + 1)) & 4294967295 from seed4, seed3 where i < 623),
seed5 as (select list(v order by i) s from seed4),
seed6 as (select list_concat([2147483648::ubigint, (xor(s[1], (xor(s[623], s[623] >> 30) * 1566083941) & 4294967295) + 4294967295) & 4294967295], s[2:623]) s from seed5),
twist(k, s) as (select 0, s from seed6 union all select k + 1, list_concat(x, y, z, [{_STEP('y[170]', 's[624]', 'x[1]')}]) from (
  select *, {part(454, 623, 'y[i - 453]')} z from (select *, {part(227, 454, 'x[i - 226]')} y from (select k, s, {part(0, 227, 's[i + 398]')} x from twist where k < ({count}) / 624.0)))),
words as (select (k - 1) * 624 + p - 1 i, s[p] w from twist, range(1, 625) r(p) where k > 0),
temper1 as (select i, xor(w, w >> 11) w from words), temper2 as (select i, xor(w, (w << 7) & 2636928640) w from temper1), temper3 as (select i, xor(w, (w << 15) & 4022730752) w from temper2),
outputs as (select i, xor(w, w >> 18) w from temper3)"""


def _interval(r: str) -> str:
    return f"""ms[({r} * 25) // 1000 + 1] ci_low, ms[least(({r} * 975) // 1000, {r} - 1) + 1] ci_high,
  least(1.0, 2.0 * least(len(list_filter(ms, lambda m: m <= 0)), len(list_filter(ms, lambda m: m >= 0))) / {r}) p_value"""


def paired(values: str, resamples: int) -> str:
    """CTEs up to intervals(g, n, delta, ci_low, ci_high, p_value, significant) of a CTE values(g, o, v)."""
    return f"""
placed as (select g, row_number() over (partition by g order by o) - 1 place, v, count(*) over (partition by g) n from {values} where v is not null),
sizes as (select distinct g, n, len(bin(n)) bits from placed), {outputs(f"select max({resamples} * 1.05 * 2 ** bits) + 5000 from sizes")},
taken as (select g, n, w >> (32 - bits) draw, row_number() over (partition by g order by i) - 1 t from outputs, sizes where w >> (32 - bits) < n),
means as (select t.g, t.t // t.n r, avg(v) m from taken t join placed p on p.g = t.g and p.place = t.draw where t.t < {resamples} * t.n group by all),
sorted as (select g, list(m order by m) ms from means group by g),
limits as (select g, {_interval(str(resamples))} from sorted),
intervals as (select p.g, any_value(p.n) n, avg(v) delta, any_value(ci_low) ci_low, any_value(ci_high) ci_high, any_value(p_value) p_value, any_value(ci_low > 0 or ci_high < 0) significant from placed p join limits using (g) group by p.g)"""


def unpaired(values: str, resamples: int) -> str:
    """CTEs up to interval(n_a, n_b, delta, ...) of a CTE values(g boolean, o, v): both groups draw from one stream in turn."""
    return f"""
sides as (select list(v order by o) filter (g) x, list(v order by o) filter (not g) y from {values} where v is not null and g is not null),
bits as (select len(x) nx, len(y) ny, 32 - len(bin(len(x))) sx, 32 - len(bin(len(y))) sy from sides), {outputs(f"select {resamples} * 1.05 * (2 ** (32 - sx) + 2 ** (32 - sy)) + 5000 from bits")},
counted as (select i, w >> sx wx, w >> sy wy, count(*) filter (w >> sx < nx) over b cx, count(*) filter (w >> sy < ny) over b cy, w >> sx < nx ax, w >> sy < ny ay from outputs, bits
  window b as (order by i rows between unbounded preceding and 1 preceding)),
lists as (select list(cx order by i) cx, list(cy order by i) cy, list(i order by i) filter (ax) px, list(i order by i) filter (ay) py, list(wx order by i) filter (ax) dx, list(wy order by i) filter (ay) dy from counted),
walk(r, pos, middle) as (select -1, 0::bigint, 0::bigint union all select r + 1, py[cy[m + 1] + ny]::bigint + 1, m from (select r, px[cx[pos + 1] + nx]::bigint + 1 m, ny, cy, py from walk, lists, bits where r < {resamples} - 1)),
begun as (select r, lag(pos) over (order by r) pos, middle from walk),
drawn as (select r, list_transform(dx[cx[pos + 1] + 1:cx[pos + 1] + nx], lambda d: x[d::bigint + 1]) vx, list_transform(dy[cy[middle + 1] + 1:cy[middle + 1] + ny], lambda d: y[d::bigint + 1]) vy from begun, lists, bits, sides where r >= 0),
sorted as (select list(list_avg(vx) - list_avg(vy) order by list_avg(vx) - list_avg(vy)) ms from drawn),
limits as (select {_interval(str(resamples))} from sorted),
interval as (select len(x) n_a, len(y) n_b, list_avg(x) - list_avg(y) delta, ci_low, ci_high, p_value, ci_low > 0 or ci_high < 0 significant from sides, limits)"""
