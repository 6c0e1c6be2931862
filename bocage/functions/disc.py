"""Closed forms for a disc drawn as a regular polygon (vertices at angle 0 and every 2*pi/n).

A straight line meets the circle through the vertices at two angles.  Inside the circle it
first crosses the cap between one side and its arc, so the side it enters through is the
side below the angle of entry: one ``floor`` finds it, whatever the number of sides.  No
side is ever enumerated, the cost is constant per segment.

All coordinates are relative to the centre of the disc.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _step(n: int) -> float:
    return 2.0 * math.pi / n


def _clip_columns(n: int, x0: str, y0: str, x1: str, y1: str, r: str) -> list[str]:
    """Steps to ``t_in, t_out``, each an expression over the ones before."""
    step, apothem = _step(n), math.cos(math.pi / n)
    out = [
        f"{x1} - {x0} AS _dx", f"{y1} - {y0} AS _dy", "_dx * _dx + _dy * _dy AS _len2",
        f"-try_divide({x0} * _dx + {y0} * _dy, _len2) AS _tc",
        f"{r} * {r} - try_divide(pow({x0} * _dy - {y0} * _dx, 2), _len2) AS _h2",
        "if(_h2 > 0, try_divide(sqrt(greatest(_h2, 0D)), sqrt(_len2)), NULL) AS _ht",
    ]
    for side, sign in (("a", "-"), ("b", "+")):
        out += [
            f"_tc {sign} _ht AS _t{side}",
            f"floor(pmod(atan2({y0} + _t{side} * _dy, {x0} + _t{side} * _dx), 2 * pi()) / {step!r}D) % {n} AS _k{side}",
            f"cos((_k{side} + 0.5D) * {step!r}D) AS _nx{side}", f"sin((_k{side} + 0.5D) * {step!r}D) AS _ny{side}",
            f"try_divide({r} * {apothem!r}D - (_nx{side} * {x0} + _ny{side} * {y0}), _nx{side} * _dx + _ny{side} * _dy) AS _c{side}",
        ]
    return out + [
        "least(greatest(_ca, 0D), 1D) AS _in", "least(greatest(_cb, 0D), 1D) AS _out",
        "coalesce(_h2 > 0 AND _ka <> _kb AND _in < _out, false) AS _hit",
        "if(_hit, _in, 1D) AS t_in", "if(_hit, _out, 1D) AS t_out",
    ]


def with_disc_clip(df: DataFrame, n: int, x0="sx", y0="sy", x1="ex", y1="ey", r="r") -> DataFrame:
    """Add ``t_in``, ``t_out``: the part of the segment (as fractions) inside the polygon.

    A segment that misses the polygon gets ``t_in = t_out = 1``.
    """
    return df.selectExpr("*", *_clip_columns(n, x0, y0, x1, y1, r)).select(*df.columns, "t_in", "t_out")


def _cap_area(x: str, r: str, n: int) -> str:
    """Area between the x axis and the upper half of the polygon, from ``x`` to ``r``; ``_k`` is the side over ``x``."""
    step, apothem = _step(n), math.cos(math.pi / n)
    return (
        f"0.5D * (_k * {r} * {r} * {math.sin(step)!r}D"
        f" + ({r} * {apothem!r}D - {x} * cos((_k + 0.5D) * {step!r}D)) / sin((_k + 0.5D) * {step!r}D) * ({r} * cos(_k * {step!r}D) - {x})"
        f" - {r} * {x} * sin(_k * {step!r}D))"
    )


def with_clamped_integral(df: DataFrame, n: int, x0="sx", y0="sy", x1="ex", y1="ey", r="r") -> DataFrame:
    """Rows with ``under`` whose sum per segment is the integral of its y, clamped to the polygon, over its x range.

    Summed with their signs over the closed boundary of any region, these integrals give the
    area of region and polygon in common; boundary parts above or below the polygon are
    clamped to its outline, parts beside it count nothing.

    The part inside is one row, each end of a clamped part another: what lies inside the disc needs no row
    for its outline.  (One expression for all of it would outgrow what the JVM compiles.)
    """
    steps = _clip_columns(n, x0, y0, x1, y1, r) + [
        f"{x0} + t_in * _dx AS _xi", f"{y0} + t_in * _dy AS _yi", f"{x0} + t_out * _dx AS _xo", f"{y0} + t_out * _dy AS _yo",
    ]
    ends = []
    for part, a, b in (("p", x0, "_xi"), ("q", "_xo", x1)):
        steps += [f"greatest(-{r}, least({r}, {v})) AS _{part}{w}" for v, w in ((a, "a"), (b, "b"))]
        # y at the middle of the part decides whether it runs above or below the polygon
        steps.append(f"signum({y0} + try_divide((_{part}a + _{part}b) / 2 - {x0}, _dx) * _dy) AS _{part}y")
        ends.append(
            f"if(coalesce(_{part}a = _{part}b OR _{part}y = 0, true), CAST(array() AS array<struct<s:double,v:double>>),"
            f" array(named_struct('s', _{part}y, 'v', _{part}a), named_struct('s', -_{part}y, 'v', _{part}b)))"
        )
    whole = "array(named_struct('s', 0D, 'v', (_yi + _yo) / 2 * (_xo - _xi)))"
    parts = df.selectExpr("*", *steps).selectExpr(*df.columns, f"inline(concat({whole}, {', '.join(ends)})) AS (_s, _v)")
    side = f"least(floor(acos(_v / {r}) / {_step(n)!r}D), {n // 2 - 1})"
    parts = parts.selectExpr("*", f"if(_s = 0, 0L, {side}) AS _k")
    return parts.selectExpr(*df.columns, f"if(_s = 0, _v, _s * ({_cap_area('_v', r, n)})) AS under")
