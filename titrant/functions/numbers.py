"""Exact decimal rounding of doubles."""

from __future__ import annotations

_SPLIT = 134217729.0  # 2**27 + 1 halves a double's digits


def exact_round_sql(x: str, digits: int) -> str:
    """SQL text that rounds the exact binary value of `x`, ties to even.

    `round` looks at the shortest decimal text of a double, so 31.15 (stored
    just below) would go up.  Here the scaled value is taken as product plus
    its exact error, and the error decides apparent ties.  One-element arrays
    bind the intermediate values, so `x` is evaluated once.
    """
    c = float(10 ** digits)
    t = _SPLIT * c
    c_hi = t - (t - c)
    c_lo = c - c_hi
    d = lambda v: f"cast({v!r} as double)"
    v_hi = f"(v * {d(_SPLIT)} - (v * {d(_SPLIT)} - v))"
    v_lo = f"(v - {v_hi})"
    err = f"((({v_hi} * {d(c_hi)} - v * {d(c)}) + {v_hi} * {d(c_lo)} + {v_lo} * {d(c_hi)}) + {v_lo} * {d(c_lo)})"
    product = f"named_struct('p', v * {d(c)}, 'f', cast(floor(v * {d(c)}) as double), 'e', {err})"
    up = "s.p - s.f > 0.5D or (s.p - s.f = 0.5D and (s.e > 0D or (s.e = 0D and s.f % 2D <> 0D)))"
    return f"transform(transform(array({x}), v -> {product}), s -> (s.f + if({up}, 1D, 0D)) / {d(c)})[0]"
