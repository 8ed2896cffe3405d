"""The deep-space part of SGP4: lunar and solar terms, and resonance of half-day and one-day orbits, with numpy.

Written from the published model (Spacetrack Report No. 3; Hujsak 1979; Vallado, Crawford, Hujsak, Kelso 2006). Arrays
hold one orbit per element; names follow the model's symbols where it has them.
"""

from __future__ import annotations

from types import SimpleNamespace as Row

import numpy as np

TWO_PI = 2 * np.pi
#: Fixed values of the model: eccentricity and mean motion (rad/min) of sun and moon, their coefficients, the sun's angles.
SUN = Row(e=0.01675, n=1.19459e-5, c=2.9864797e-6, sin_i=0.39785416, cos_i=0.91744867, sin_g=-0.98088458, cos_g=0.1945905)
MOON = Row(e=0.05490, n=1.5835218e-4, c=4.7968065e-7)
#: Rotation of the Earth in rad/min.
EARTH_RATE = 4.37526908801129966e-3
#: Resonance coefficients and phases, fixed values of the model.
Q22, Q31, Q33 = 1.7891679e-6, 2.1460748e-6, 2.2123015e-7
ROOT22, ROOT32, ROOT44, ROOT52, ROOT54 = 1.7891679e-6, 3.7393792e-7, 7.3636953e-9, 1.1428639e-7, 2.1765803e-9
DAY_PHASES = (0.13130908, 2.8843198, 0.37448087)
HALF_PHASES = Row(g22=5.7686396, g32=0.95240898, g44=1.8014998, g52=1.0508330, g54=4.4108898)
STEP = 720.0


def sidereal(days: np.ndarray) -> np.ndarray:
    """Greenwich sidereal angle at days since 1949-12-31."""
    t = (days + 2433281.5 - 2451545.0) / 36525.0
    seconds = -6.2e-6 * t**3 + 0.093104 * t**2 + (876600.0 * 3600 + 8640184.812866) * t + 67310.54841
    return np.mod(np.radians(seconds / 240.0), TWO_PI)


def _body(sin_g, cos_g, sin_i, cos_i, sin_h, cos_h, c, o) -> Row:
    """The terms that one perturbing body gives an orbit `o`."""
    a1, a3 = cos_g * cos_h + sin_g * cos_i * sin_h, -sin_g * cos_h + cos_g * cos_i * sin_h
    a7, a8 = -cos_g * sin_h + sin_g * cos_i * cos_h, sin_g * sin_i
    a9, a10 = sin_g * sin_h + cos_g * cos_i * cos_h, cos_g * sin_i
    a2, a4 = o.cos_i * a7 + o.sin_i * a8, o.cos_i * a9 + o.sin_i * a10
    a5, a6 = -o.sin_i * a7 + o.cos_i * a8, -o.sin_i * a9 + o.cos_i * a10
    x1, x2 = a1 * o.cos_w + a2 * o.sin_w, a3 * o.cos_w + a4 * o.sin_w
    x3, x4 = -a1 * o.sin_w + a2 * o.cos_w, -a3 * o.sin_w + a4 * o.cos_w
    x5, x6, x7, x8 = a5 * o.sin_w, a6 * o.sin_w, a5 * o.cos_w, a6 * o.cos_w
    e2 = o.e**2
    r = Row(z31=12 * x1**2 - 3 * x3**2, z32=24 * x1 * x2 - 6 * x3 * x4, z33=12 * x2**2 - 3 * x4**2)
    z1, z2, z3 = 3 * (a1**2 + a2**2) + r.z31 * e2, 6 * (a1 * a3 + a2 * a4) + r.z32 * e2, 3 * (a3**2 + a4**2) + r.z33 * e2
    r.z1, r.z2, r.z3 = (2 * z + (1 - e2) * q for z, q in ((z1, r.z31), (z2, r.z32), (z3, r.z33)))
    r.z11 = -6 * a1 * a5 + e2 * (-24 * x1 * x7 - 6 * x3 * x5)
    r.z12 = -6 * (a1 * a6 + a3 * a5) + e2 * (-24 * (x2 * x7 + x1 * x8) - 6 * (x3 * x6 + x4 * x5))
    r.z13 = -6 * a3 * a6 + e2 * (-24 * x2 * x8 - 6 * x4 * x6)
    r.z21 = 6 * a2 * a5 + e2 * (24 * x1 * x5 - 6 * x3 * x7)
    r.z22 = 6 * (a4 * a5 + a2 * a6) + e2 * (24 * (x2 * x5 + x1 * x6) - 6 * (x4 * x7 + x3 * x8))
    r.z23 = 6 * a4 * a6 + e2 * (24 * x2 * x6 - 6 * x4 * x8)
    r.s3 = c / o.n
    r.s2 = -0.5 * r.s3 / np.sqrt(1 - e2)
    r.s4 = r.s3 * np.sqrt(1 - e2)
    r.s1 = -15 * o.e * r.s4
    r.s5, r.s6, r.s7 = x1 * x3 + x2 * x4, x2 * x3 + x1 * x4, x2 * x4 - x1 * x3
    return r


def bodies(o: Row, days: np.ndarray) -> tuple[Row, Row]:
    """Sun and moon at an epoch, with their mean anomalies `m` there."""
    day = days + 18261.5
    node = np.mod(4.5236020 - 9.2422029e-4 * day, TWO_PI)
    cos_i = 0.91375164 - 0.03568096 * np.cos(node)
    sin_i = np.sqrt(1 - cos_i**2)
    sin_h = 0.089683511 * np.sin(node) / sin_i
    cos_h = np.sqrt(1 - sin_h**2)
    gamma = 5.8351514 + 0.0019443680 * day
    angle = gamma + np.arctan2(0.39785416 * np.sin(node) / sin_i, cos_h * np.cos(node) + 0.91744867 * sin_h * np.sin(node)) - node
    sun = _body(SUN.sin_g, SUN.cos_g, SUN.sin_i, SUN.cos_i, o.sin_h, o.cos_h, SUN.c, o)
    moon = _body(np.sin(angle), np.cos(angle), sin_i, cos_i, o.sin_h * cos_h - o.cos_h * sin_h, cos_h * o.cos_h + sin_h * o.sin_h, MOON.c, o)
    sun.m, moon.m = np.mod(6.2565837 + 0.017201977 * day, TWO_PI), np.mod(4.7199672 + 0.22997150 * day - gamma, TWO_PI)
    return sun, moon


def _periodic(b: Row, k: Row, e2: np.ndarray, t: np.ndarray) -> tuple:
    """What a body adds at time t to eccentricity, inclination, mean anomaly, perigee and node."""
    zm = b.m + k.n * t
    zf = zm + 2 * k.e * np.sin(zm)
    s = np.sin(zf)
    f2, f3 = 0.5 * s**2 - 0.25, -0.5 * s * np.cos(zf)
    return (
        2 * b.s1 * (b.s6 * f2 + b.s7 * f3), 2 * b.s2 * (b.z12 * f2 + (b.z13 - b.z11) * f3), -2 * b.s3 * (b.z2 * f2 + (b.z3 - b.z1) * f3 + (-21 - 9 * e2) * k.e * s),
        2 * b.s4 * (b.z32 * f2 + (b.z33 - b.z31) * f3 - 9 * k.e * s), -2 * b.s2 * (b.z22 * f2 + (b.z23 - b.z21) * f3),
    )


def periodic(sun: Row, moon: Row, e0: np.ndarray, t, e, i, node, arg, m) -> tuple:
    """Elements with the long-period lunar and solar terms; near the equator by the Lyddane form."""
    de, di, dm, dg, dh = (x + y for x, y in zip(_periodic(sun, SUN, e0**2, t), _periodic(moon, MOON, e0**2, t), strict=True))
    i, e = i + di, e + de
    sin_i, cos_i = np.sin(i), np.cos(i)
    steep = i >= 0.2
    h = dh / np.where(steep, sin_i, 1)
    alpha = sin_i * np.sin(node) + dh * np.cos(node) + di * cos_i * np.sin(node)
    beta = sin_i * np.cos(node) - dh * np.sin(node) + di * cos_i * np.cos(node)
    wrapped = np.fmod(node, TWO_PI)
    length = m + arg + cos_i * wrapped + dm + dg - di * wrapped * sin_i
    flat = np.arctan2(alpha, beta)
    flat = np.where(np.abs(wrapped - flat) > np.pi, np.where(flat < wrapped, flat + TWO_PI, flat - TWO_PI), flat)
    new_node = np.where(steep, node + h, flat)
    new_arg = np.where(steep, arg + dg - cos_i * h, length - (m + dm) - cos_i * flat)
    return e, i, new_node, new_arg, m + dm


def secular(sun: Row, moon: Row, o: Row) -> Row:
    """Rates of eccentricity, inclination, mean anomaly, perigee and node."""
    e2 = o.e**2
    level = (o.i < 5.2359877e-2) | (o.i > np.pi - 5.2359877e-2)
    safe = np.where(o.sin_i == 0, 1, o.sin_i)
    out = Row(e=0.0, i=0.0, m=0.0, arg=0.0, node=0.0)
    for b, k in ((sun, SUN), (moon, MOON)):
        out.e = out.e + b.s1 * k.n * b.s5
        out.i = out.i + b.s2 * k.n * (b.z11 + b.z13)
        out.m = out.m - k.n * b.s3 * (b.z1 + b.z3 - 14 - 6 * e2)
        h = np.where(level, 0.0, -k.n * b.s2 * (b.z21 + b.z23)) / safe
        out.arg = out.arg + b.s4 * k.n * (b.z31 + b.z33 - 6) - o.cos_i * h
        out.node = out.node + h
    return out


def _half_day(o: Row, a_inv: np.ndarray) -> dict[str, np.ndarray]:
    """Coefficients of the half-day resonance; polynomials in the eccentricity, fixed values of the model."""
    e, s, c = o.e, o.sin_i, o.cos_i
    s2, c2 = s**2, c**2
    poly = lambda *k: sum(x * e**n for n, x in enumerate(k))
    low, mid = e <= 0.65, e < 0.7
    g201 = -0.306 - (e - 0.64) * 0.440
    g211 = np.where(low, poly(3.616, -13.2470, 16.2900), poly(-72.099, 331.819, -508.738, 266.724))
    g310 = np.where(low, poly(-19.302, 117.3900, -228.4190, 156.5910), poly(-346.844, 1582.851, -2415.925, 1246.113))
    g322 = np.where(low, poly(-18.9068, 109.7927, -214.6334, 146.5816), poly(-342.585, 1554.908, -2366.899, 1215.972))
    g410 = np.where(low, poly(-41.122, 242.6940, -471.0940, 313.9530), poly(-1052.797, 4758.686, -7193.992, 3651.957))
    g422 = np.where(low, poly(-146.407, 841.8800, -1629.014, 1083.4350), poly(-3581.690, 16178.110, -24462.770, 12422.520))
    g520 = np.where(low, poly(-532.114, 3017.977, -5740.032, 3708.2760), np.where(e > 0.715, poly(-5149.66, 29936.92, -54087.36, 31324.56), poly(1464.74, -4664.75, 3763.64)))
    g533 = np.where(mid, poly(-919.22770, 4988.6100, -9064.7700, 5542.21), poly(-37995.780, 161616.52, -229838.20, 109377.94))
    g521 = np.where(mid, poly(-822.71072, 4568.6173, -8491.4146, 5337.524), poly(-51752.104, 218913.95, -309468.16, 146349.42))
    g532 = np.where(mid, poly(-853.66600, 4690.2500, -8624.7700, 5341.4), poly(-40023.880, 170470.89, -242699.48, 115605.82))
    f220, f221 = 0.75 * (1 + 2 * c + c2), 1.5 * s2
    f321, f322 = 1.875 * s * (1 - 2 * c - 3 * c2), -1.875 * s * (1 + 2 * c - 3 * c2)
    f441, f442 = 35 * s2 * f220, 39.3750 * s2**2
    f522 = 9.84375 * s * (s2 * (1 - 2 * c - 5 * c2) + 0.33333333 * (-2 + 4 * c + 6 * c2))
    f523 = s * (4.92187512 * s2 * (-2 - 4 * c + 10 * c2) + 6.56250012 * (1 + 2 * c - 3 * c2))
    f542 = 29.53125 * s * (2 - 8 * c + c2 * (-12 + 8 * c + 10 * c2))
    f543 = 29.53125 * s * (-2 - 8 * c + c2 * (12 + 8 * c - 10 * c2))
    k = 3 * o.n**2 * a_inv**2
    k3, k4, k5 = k * a_inv, k * a_inv**2, k * a_inv**3
    return {
        "d2201": k * ROOT22 * f220 * g201, "d2211": k * ROOT22 * f221 * g211, "d3210": k3 * ROOT32 * f321 * g310, "d3222": k3 * ROOT32 * f322 * g322, "d4410": 2 * k4 * ROOT44 * f441 * g410, "d4422": 2 * k4 * ROOT44 * f442 * g422,
        "d5220": k5 * ROOT52 * f522 * g520, "d5232": k5 * ROOT52 * f523 * g532, "d5421": 2 * k5 * ROOT54 * f542 * g521, "d5433": 2 * k5 * ROOT54 * f543 * g533,
    }


def resonant(o: Row, rate: Row, m_dot, arg_dot, node_dot, arg0, node0, m0, gst, t, ke) -> Row:
    """Mean motion and mean longitude under resonance at time t; `kind` is 0 without, 1 for a day, 2 for half a day."""
    kind = np.where((o.n > 0.0034906585) & (o.n < 0.0052359877), 1, np.where((o.n >= 8.26e-3) & (o.n <= 9.24e-3) & (o.e >= 0.5), 2, 0))
    a_inv = (o.n / ke) ** (2 / 3)
    e2, one = o.e**2, 1 + o.cos_i
    k = 3 * o.n**2 * a_inv**2
    del2 = 2 * k * 0.75 * one**2 * (1 + e2 * (-2.5 + 0.8125 * e2)) * Q22
    del3 = 3 * k * 1.875 * one**3 * (1 + e2 * (-6 + 6.60937 * e2)) * Q33 * a_inv
    del1 = k * (0.9375 * o.sin_i**2 * (1 + 3 * o.cos_i) - 0.75 * one) * (1 + 2 * e2) * Q31 * a_inv
    half = _half_day(o, a_inv)
    drift = np.where(kind == 1, m_dot + arg_dot + node_dot - EARTH_RATE + rate.m + rate.arg + rate.node - o.n, m_dot + rate.m + 2 * (node_dot + rate.node - EARTH_RATE) - o.n)
    xli, xni, at = np.where(kind == 1, m0 + node0 + arg0 - gst, m0 + 2 * node0 - 2 * gst), o.n.copy(), np.zeros(len(t))

    def slopes():
        d = [(del1, 1, DAY_PHASES[0]), (del2, 2, DAY_PHASES[1]), (del3, 3, DAY_PHASES[2])]
        day = sum(c * np.sin(n * (xli - p)) for c, n, p in d), sum(n * c * np.cos(n * (xli - p)) for c, n, p in d)
        w, g = arg0 + arg_dot * at, HALF_PHASES
        h = [("d2201", 2, 1, g.g22), ("d2211", 0, 1, g.g22), ("d3210", 1, 1, g.g32), ("d3222", -1, 1, g.g32), ("d4410", 2, 2, g.g44), ("d4422", 0, 2, g.g44), ("d5220", 1, 1, g.g52), ("d5232", -1, 1, g.g52), ("d5421", 1, 2, g.g54), ("d5433", -1, 2, g.g54)]
        two = sum(half[c] * np.sin(x * w + y * xli - p) for c, x, y, p in h), sum(y * half[c] * np.cos(x * w + y * xli - p) for c, x, y, p in h)
        along = xni + drift
        return np.where(kind == 1, day[0], two[0]), along, np.where(kind == 1, day[1], two[1]) * along

    step = np.where(t >= 0, STEP, -STEP)
    while True:
        xndt, xldot, xnddt = slopes()
        on = (kind > 0) & (np.abs(t - at) >= STEP)
        if not on.any():
            break
        xli = np.where(on, xli + xldot * step + xndt * STEP**2 / 2, xli)
        xni = np.where(on, xni + xndt * step + xnddt * STEP**2 / 2, xni)
        at = np.where(on, at + step, at)
    rest = t - at
    return Row(kind=kind, n=xni + xndt * rest + xnddt * rest**2 / 2, length=xli + xldot * rest + xndt * rest**2 / 2, theta=np.mod(gst + t * EARTH_RATE, TWO_PI))
