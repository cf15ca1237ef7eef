"""Filters, envelopes, wavelets and spectra as DuckDB text, written from their definitions and not from the kernels.

A filter is taken apart into its poles: its response to a unit pulse is a sum of one damped oscillation a pole, and what
an endless constant input before the first sample leaves behind is the tail of that sum. Filtering is a dot product.
"""

from __future__ import annotations

# Low-pass taps of the Daubechies wavelet with 4 vanishing moments.
DB4 = (
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
)


def response(name: str, kind: str, order: int, low: float, high: float, fs: float, room: int, q: float = 30.0) -> list[str]:
    """CTEs that end in ``<name>(h, t)``: the first ``room`` values of the pulse response, last one first, and for each
    place what a constant 1 before the first sample still adds."""
    warp = lambda f: f"(4 * tan(pi() * {f!r}::double / {fs!r}::double))"
    n = f"{name}_"
    if kind == "notch":
        w = f"(2 * pi() * {low!r}::double / {fs!r}::double)"
        g = f"(1 / (1 + tan({w} / (2 * {q!r}::double))))"
        top = f"sqrt(2 * {g} - 1 - ({g} * cos({w})) ** 2)"
        poles = [f"{n}poles as (select unnest([0, 1]) as k, {g} * cos({w}) as re, unnest([1, -1]) * {top} as im)"]
        zeros = f"{n}zeros as (select cos({w}) as re, unnest([1, -1]) * sin({w}) as im)"
        ref = "1.0::double as re, 0.0::double as im"
    else:
        poles = [f"{n}proto as (select -cos(pi() * m / {2 * order}) as re, -sin(pi() * m / {2 * order}) as im from (select unnest(generate_series({1 - order}, {order - 1}, 2)) as m))"]
        if kind == "lowpass":
            poles.append(f"{n}analog as (select re * {warp(high)} as re, im * {warp(high)} as im from {n}proto)")
            zeros = f"{n}zeros as (select -1.0::double as re, 0.0::double as im from range({order}))"
            ref = "1.0::double as re, 0.0::double as im"
        else:
            width, square = f"({warp(high)} - {warp(low)})", f"({warp(high)} * {warp(low)})"
            scaled = f"re * {width} / 2 as re, im * {width} / 2 as im" if kind == "bandpass" else f"re * {width} / 2 as re, -im * {width} / 2 as im"
            poles += [
                f"{n}half as (select {scaled} from {n}proto)",
                f"{n}under as (select re, im, re * re - im * im - {square} as a, 2 * re * im as b from {n}half)",
                f"{n}root as (select re, im, sqrt(greatest(0, (sqrt(a * a + b * b) + a) / 2)) as c, case when b < 0 then -1 else 1 end * sqrt(greatest(0, (sqrt(a * a + b * b) - a) / 2)) as d from {n}under)",
                f"{n}analog as (select re + s * c as re, im + s * d as im from {n}root, (select unnest([1, -1]) as s))",
            ]
            middle = f"(16 - {square}) / (16 + {square}) as re, 8 * sqrt({square}) / (16 + {square}) as im"
            if kind == "bandpass":
                zeros, ref = f"{n}zeros as (select unnest([1.0, -1.0])::double as re, 0.0::double as im from range({order}))", middle
            else:
                zeros, ref = f"{n}zeros as (select m.re, s * m.im as im from (select {middle}) m, (select unnest([1, -1]) as s), range({order}))", "1.0::double as re, 0.0::double as im"
        poles.append(f"{n}poles as (select row_number() over () as k, (16 - re * re - im * im) / ((4 - re) ** 2 + im * im) as re, 8 * im / ((4 - re) ** 2 + im * im) as im from {n}analog)")
    size, angle = "ln(sqrt({0} ** 2 + {1} ** 2))", "atan2({1}, {0})"
    of = lambda a, b, f: f"sum({f.format(f'({a}.re - {b}.re)', f'({a}.im - {b}.im)')})"
    return [
        *poles, zeros, f"{n}ref as (select {ref})",
        # the gain makes the response 1 in the pass band's middle
        f"{n}gain as (select (select {of('p', 'r', size)} from {n}poles p, {n}ref r) - (select {of('z', 'r', size)} from {n}zeros z, {n}ref r) as g)",
        f"{n}above as (select p.k, {of('p', 'z', size)} as s, {of('p', 'z', angle)} as a from {n}poles p, {n}zeros z group by p.k)",
        f"{n}below as (select p.k, {of('p', 'o', size)} as s, {of('p', 'o', angle)} as a from {n}poles p, {n}poles o where p.k <> o.k group by p.k)",
        f"""{n}part as (select exp(g + above.s - below.s - ln(sqrt(re ** 2 + im ** 2))) as r, above.a - below.a - atan2(im, re) as a, sqrt(re ** 2 + im ** 2) as size, atan2(im, re) as turn,
  sqrt((1 - re) ** 2 + im ** 2) as left_size, atan2(-im, 1 - re) as left_turn from {n}poles join {n}above above using (k) join {n}below below using (k), {n}gain)""",
        f"""{n}direct as (select exp(g + (select sum({size.format('re', 'im')}) from {n}zeros) - (select sum({size.format('re', 'im')}) from {n}poles))
  * cos((select sum({angle.format('re', 'im')}) from {n}zeros) - (select sum({angle.format('re', 'im')}) from {n}poles)) as d from {n}gain)""",
        f"""{n}pulse as (select m, sum(r * size ** m * cos(a + m * turn)) + case when m = 0 then (select d from {n}direct) else 0 end as h,
  sum(r * size ** (m + 1) / left_size * cos(a + (m + 1) * turn - left_turn)) as t from {n}part, (select range as m from range({room})) group by m)""",
        f"{name} as materialized (select list(h order by m desc) as h, list(t order by m) as t from {n}pulse)",
    ]


def one_pass(filter_: str, x: str, room: int, start: str) -> str:
    """The causal filter of a list, whose past was the constant ``start``."""
    return f"[list_dot_product({x}[1:i + 1], {filter_}.h[{room} - i:{room}]) + {start} * {filter_}.t[i + 1] for i in range(len({x}))]"


def zero_phase(name: str, source: str, keys: str, filter_: str, pad: int, room: int, column: str = "x") -> list[str]:
    """CTEs that end in ``<name>``: ``keys`` and ``column`` filtered forward and backward, with odd extension."""
    c = column
    return [
        f"{name}_e as (select {keys}, len({c}) as n, list_concat([2 * {c}[1] - {c}[{pad} + 1 - k] for k in range({pad})], {c}, [2 * {c}[len({c})] - {c}[len({c}) - 1 - k] for k in range({pad})]) as x from {source})",
        f"{name}_f as (select {keys}, n, list_reverse({one_pass(filter_, 'x', room, 'x[1]')}) as x from {name}_e, {filter_})",
        f"{name} as (select {keys}, list_reverse({one_pass(filter_, 'x', room, 'x[1]')})[{pad} + 1:{pad} + n] as {column} from {name}_f, {filter_})",
    ]


def envelope(name: str, source: str, keys: str, column: str = "x") -> list[str]:
    """CTEs that end in ``<name>``: the size of the analytic signal; the Hilbert kernel of a list of even length is a
    cotangent at odd distances, of odd length a sum of sines in closed form."""
    kernel = "case when m = 0 then 0 when _n % 2 = 1 then (cos(pi() * m / _n) - (-1) ** (abs(m) % 2)) / (_n * sin(pi() * m / _n)) when m % 2 = 0 then 0 else 2 / (_n * tan(pi() * m / _n)) end"
    return [
        f"{name}_k as materialized (select _n, list(v order by m) as _k from (select _n, m, {kernel} as v from (select distinct len({column})::bigint as _n from {source}), lateral (select unnest(generate_series(1 - _n, _n - 1)) as m)) group by _n)",
        f"{name} as (select {keys}, [sqrt({column}[j + 1] ** 2 + list_dot_product({column}, list_reverse(_k[j + 1:j + _n])) ** 2) for j in range(_n)] as {column} from {source} join {name}_k on _n = len({column}))",
    ]


def wavelet(name: str, source: str, keys: str, level: int = 7, soften: int = 4, column: str = "x") -> list[str]:
    """CTEs that end in ``<name>``: ``keys, x, ref``, with the coarsest ``soften`` detail bands softened."""
    low = "[" + ", ".join(map(repr, DB4)) + "]::double[]"
    back = "[" + ", ".join(map(repr, DB4[::-1])) + "]::double[]"
    # dec_hi[k] = (-1)^(k + 1) dec_lo[7 - k]
    high = [(-1) ** (k + 1) * DB4[7 - k] for k in range(8)]
    up, down = "[" + ", ".join(map(repr, high)) + "]::double[]", "[" + ", ".join(map(repr, high[::-1])) + "]::double[]"
    out = [f"{name}_0 as (select {keys}, {column} as x, {column} as a from {source})"]
    kept = ""
    for l in range(1, level + 1):
        e = "list_concat(list_reverse(a[1:7]), a, list_reverse(a[len(a) - 6:len(a)]))"
        out.append(f"{name}_e{l} as (select *, {e} as e, (len(a) + 7) // 2 as m from {name}_{l - 1})")
        out.append(f"{name}_{l} as (select {keys}, x{kept}, [list_dot_product(e[2 * o + 2:2 * o + 9], {back}) for o in range(m)] as a, [list_dot_product(e[2 * o + 2:2 * o + 9], {down}) for o in range(m)] as d{l} from {name}_e{l})")
        kept += f", d{l}"
    before = f"{name}_{level}"
    for i, l in enumerate(range(level, 0, -1), 1):
        d = f"d{l}"
        if i <= soften:
            out.append(f"{name}_m{l} as (select *, list_aggregate({d}, 'median') as mid from {before})")
            out.append(f"{name}_t{l} as (select *, list_aggregate([abs(v - mid) for v in {d}], 'median') / 0.6745::double * sqrt(2 * ln(len(x))) as cut from {name}_m{l})")
            before, d = f"{name}_t{l}", f"[sign(v) * greatest(abs(v) - cut, 0) for v in {d}]"
        spread = lambda v: f"[case when t % 2 = 0 then 0 else {v}[(t + 1) // 2] end for t in range(2 * len({v}) + 1)]"
        # the last frames of a deeper level may be one longer than this level's detail
        out.append(f"{name}_s{l} as (select {keys}, x{kept}, a[1:len(d{l})] as a, {d} as d from {before})")
        out.append(f"{name}_u{l} as (select {keys}, x{kept}, len(d) as m, {spread('a')} as p, {spread('d')} as q from {name}_s{l})")
        out.append(f"{name}_r{l} as (select {keys}, x{kept}, [list_dot_product(p[n + 1:n + 8], {low}) + list_dot_product(q[n + 1:n + 8], {up}) for n in range(2 * m - 6)] as a from {name}_u{l})")
        before = f"{name}_r{l}"
    out.append(f"{name} as (select {keys}, x, a[1:len(x)] as ref from {before})")
    return out


def cancel(name: str, source: str, keys: str, room: int, forget: float = 0.98, p0: float = 1e4) -> list[str]:
    """CTEs that end in ``<name>``: ``keys, x, ref, clean, weight`` of the one-tap canceller, by its discounted sums."""
    fade = f"[{forget!r}::double ** ({room} - 1 - m) for m in range({room})]"
    return [
        f"{name}_s as (select {keys}, x, ref, [a * a for a in ref] as rr, list_transform(list_zip(x, ref), lambda p: p[1] * p[2]) as rx, {fade} as fade from {source})",
        f"{name}_w as (select {keys}, x, ref, [({forget!r}::double ** k / {p0!r} + case when k = 0 then 0 else list_dot_product(rx[1:k], fade[{room} - k + 1:{room}]) end)"
        f" / ({forget!r}::double ** k / {p0!r} + case when k = 0 then 0 else list_dot_product(rr[1:k], fade[{room} - k + 1:{room}]) end) for k in range(len(x))] as weight from {name}_s)",
        f"{name} as (select {keys}, x, ref, weight, [x[k + 1] - weight[k + 1] * ref[k + 1] for k in range(len(x))] as clean from {name}_w)",
    ]


def alpha_area(x: str, fs: str, low: float = 8.0, high: float = 13.0) -> str:
    """Area between ``low`` and ``high`` under Welch's density of a list, whose segments are a quarter of it."""
    n = f"greatest(1, least(256, len({x}) // 4))"
    bins = f"[i for i in range({n} // 2 + 1) if i * {fs} / {n} between {low!r} and {high!r}]"
    hop, win = f"({n} - {n} // 2)", f"(0.5 - 0.5 * cos(2 * pi() * j / {n}))"
    part = lambda f: f"list_sum([({x}[s * {hop} + j + 1] - list_avg({x}[s * {hop} + 1:s * {hop} + {n}])) * {win} * {f}(2 * pi() * ((i * j) % {n}) / {n}) for j in range({n})])"
    power = f"[list_avg([{part('cos')} ** 2 + {part('sin')} ** 2 for s in range((len({x}) - {n}) // {hop} + 1)]) * 2 / ({fs} * list_sum([{win} ** 2 for j in range({n})])) for i in {bins}]"
    return f"(select coalesce(({fs} / {n}) * (list_sum(p) - (p[1] + p[len(p)]) / 2), 0) from (select {power} as p))"
