"""SGP4 propagation and orbit-frame differences, vectorised with numpy.

Written from the published model (Spacetrack Report No. 3; Vallado, Crawford, Hujsak, Kelso 2006) with the WGS-72
constants. Orbits of 225 minutes and more get the deep-space terms, which depend on the epoch itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import deep_space

#: WGS-72 and zonal harmonics, fixed values of the model.
MU, RADIUS = 398600.8, 6378.135
J2, J3, J4 = 0.001082616, -0.00000253881, -0.00000165597
KE = 60.0 / np.sqrt(RADIUS**3 / MU)
OK, BAD_ELEMENT, BAD_ECCENTRICITY, BAD_MEAN_MOTION, BAD_PERTURBED, BAD_SEMI_LATUS, DECAYED = 0, -1, 1, 2, 3, 4, 6
FIELDS = ("epoch", "inclination", "eccentricity", "mean_motion", "bstar", "raan", "arg_perigee", "mean_anomaly")


def propagate(inclination, eccentricity, mean_motion, bstar, raan, arg_perigee, mean_anomaly, minutes, epoch_days):
    """Position (km), velocity (km/s) and error code after `minutes` from the epoch.

    Angles in degrees, mean motion in revolutions a day, the epoch in days since 1949-12-31; all arguments are arrays of
    one length. Rows in error have nan.
    """
    arrays = [np.asarray(x, float) for x in (inclination, eccentricity, mean_motion, raan, arg_perigee, mean_anomaly, minutes, epoch_days)]
    incl, e0, revs, node0, arg0, m0, t, days = arrays
    bstar = np.nan_to_num(np.asarray(bstar, float))
    error = np.zeros(len(t), int)
    bad = ~np.isfinite(np.sum(arrays, axis=0)) | ~(revs > 0) | ~((e0 >= 0) & (e0 < 1)) | ~((incl >= 0) & (incl <= 180))
    error[bad] = BAD_ELEMENT
    incl, e0, revs, node0, arg0, m0, t, days = (np.where(bad, safe, x) for x, safe in ((incl, 50.0), (e0, 0.001), (revs, 15.0), (node0, 0.0), (arg0, 0.0), (m0, 0.0), (t, 0.0), (days, 0.0)))
    i0, node0, arg0, m0 = (np.radians(x) for x in (incl, node0, arg0, m0))
    with np.errstate(all="ignore"):
        # mean motion and semi-major axis without the secular effect of J2
        n_kozai = revs * 2 * np.pi / 1440.0
        cos_i, sin_i = np.cos(i0), np.sin(i0)
        theta2 = cos_i**2
        beta2 = 1 - e0**2
        beta = np.sqrt(beta2)
        a1 = (KE / n_kozai) ** (2 / 3)
        d = 0.75 * J2 * (3 * theta2 - 1) / (beta * beta2)
        d1 = d / a1**2
        a0 = a1 * (1 - d1 / 3 - d1**2 - 134 / 81 * d1**3)
        n0 = n_kozai / (1 + d / a0**2)
        a = (KE / n0) ** (2 / 3)
        deep = 2 * np.pi / n0 >= 225
        perigee = (a * (1 - e0) - 1) * RADIUS
        # atmosphere parameters
        s = np.where(perigee < 98, 20.0, np.where(perigee < 156, perigee - 78, 78.0))
        q4 = np.where(perigee < 156, ((120 - s) / RADIUS) ** 4, ((120 - 78) / RADIUS) ** 4)
        s = s / RADIUS + 1
        xi = 1 / (a - s)
        eta = a * e0 * xi
        eta2, e_eta = eta**2, e0 * eta
        psi2 = np.abs(1 - eta2)
        coef = q4 * xi**4
        coef1 = coef / psi2**3.5
        c2 = coef1 * n0 * (a * (1 + 1.5 * eta2 + e_eta * (4 + eta2)) + 0.375 * J2 * xi / psi2 * (3 * theta2 - 1) * (8 + 3 * eta2 * (8 + eta2)))
        c1 = bstar * c2
        c3 = np.where(e0 > 1e-4, -2 * coef * xi * (J3 / J2) * n0 * sin_i / np.maximum(e0, 1e-12), 0.0)
        x1mth2, x3thm1, x7thm1 = 1 - theta2, 3 * theta2 - 1, 7 * theta2 - 1
        c4 = 2 * n0 * coef1 * a * beta2 * (eta * (2 + 0.5 * eta2) + e0 * (0.5 + 2 * eta2) - J2 * xi / (a * psi2) * (-3 * x3thm1 * (1 - 2 * e_eta + eta2 * (1.5 - 0.5 * e_eta)) + 0.75 * x1mth2 * (2 * eta2 - e_eta * (1 + eta2)) * np.cos(2 * arg0)))
        c5 = 2 * coef1 * a * beta2 * (1 + 2.75 * (eta2 + e_eta) + e_eta * eta2)
        # secular rates
        p2 = (a * beta2) ** -2
        k1, k2, k3 = 1.5 * J2 * p2 * n0, 0.5 * (1.5 * J2 * p2 * n0) * J2 * p2, -0.46875 * J4 * p2**2 * n0
        theta4 = theta2**2
        m_dot = n0 + 0.5 * k1 * beta * x3thm1 + 0.0625 * k2 * beta * (13 - 78 * theta2 + 137 * theta4)
        arg_dot = -0.5 * k1 * (1 - 5 * theta2) + 0.0625 * k2 * (7 - 114 * theta2 + 395 * theta4) + k3 * (3 - 36 * theta2 + 49 * theta4)
        node_j2 = -k1 * cos_i
        node_dot = node_j2 + (0.5 * k2 * (4 - 19 * theta2) + 2 * k3 * (3 - 7 * theta2)) * cos_i
        node_drag = 3.5 * beta2 * node_j2 * c1
        simple = (perigee < 220) | deep
        arg_drag = bstar * c3 * np.cos(arg0)
        m_drag = np.where(e0 > 1e-4, -2 / 3 * coef * bstar / np.where(e_eta == 0, 1, e_eta), 0.0)
        delta_m0 = (1 + eta * np.cos(m0)) ** 3
        t2, t3, t4 = t**2, t**3, t**4
        m = m0 + m_dot * t
        arg = arg0 + arg_dot * t
        node = node0 + node_dot * t + node_drag * t2
        full = np.where(simple, 0.0, 1.0)
        shift = full * (arg_drag * t + m_drag * ((1 + eta * np.cos(m)) ** 3 - delta_m0))
        m, arg = m + shift, arg - shift
        d2 = 4 * a * xi * c1**2
        step = d2 * xi * c1 / 3
        d3 = (17 * a + s) * step
        d4 = 0.5 * step * a * xi * (221 * a + 31 * s) * c1
        shrink = 1 - c1 * t - full * (d2 * t2 + d3 * t3 + d4 * t4)
        drop_e = bstar * c4 * t + full * bstar * c5 * (np.sin(m) - np.sin(m0))
        length = 1.5 * c1 * t2 + full * ((d2 + 2 * c1**2) * t3 + 0.25 * (3 * d3 + c1 * (12 * d2 + 10 * c1**2)) * t4 + 0.2 * (3 * d4 + 12 * c1 * d3 + 6 * d2**2 + 15 * c1**2 * (2 * d2 + c1**2)) * t4 * t)
        error[(error == OK) & ~(n0 > 0)] = BAD_MEAN_MOTION
        # deep space: secular lunar and solar rates, and resonance
        n, e, ik = n0.copy(), e0.copy(), i0.copy()
        d = np.flatnonzero(deep)
        if len(d):
            o = deep_space.Row(e=e0[d], n=n0[d], i=i0[d], sin_i=sin_i[d], cos_i=cos_i[d], sin_w=np.sin(arg0[d]), cos_w=np.cos(arg0[d]), sin_h=np.sin(node0[d]), cos_h=np.cos(node0[d]))
            sun, moon = deep_space.bodies(o, days[d])
            rate = deep_space.secular(sun, moon, o)
            e[d], ik[d], m[d], arg[d], node[d] = (x[d] + r * t[d] for x, r in ((e, rate.e), (ik, rate.i), (m, rate.m), (arg, rate.arg), (node, rate.node)))
            res = deep_space.resonant(o, rate, m_dot[d], arg_dot[d], node_dot[d], arg0[d], node0[d], m0[d], deep_space.sidereal(days[d]), t[d], KE)
            n[d] = np.where(res.kind > 0, res.n, n[d])
            m[d] = np.where(res.kind == 1, res.length - node[d] - arg[d] + res.theta, np.where(res.kind == 2, res.length - 2 * node[d] + 2 * res.theta, m[d]))
        am = (KE / n) ** (2 / 3) * shrink**2
        n = KE / am**1.5
        e = e - drop_e
        error[(error == OK) & ((e >= 1) | (e < -0.001) | (am < 0.95))] = BAD_ECCENTRICITY
        e = np.maximum(e, 1e-6)
        m = m + n0 * length
        u = m + arg + node
        node, arg, u = np.fmod(node, 2 * np.pi), np.fmod(arg, 2 * np.pi), np.fmod(u, 2 * np.pi)
        m = np.fmod(u - arg - node, 2 * np.pi)
        if len(d):
            e[d], ik[d], node[d], arg[d], m[d] = deep_space.periodic(sun, moon, o.e, t[d], e[d], ik[d], node[d], arg[d], m[d])
            under = ik < 0
            ik, node, arg = np.where(under, -ik, ik), np.where(under, node + np.pi, node), np.where(under, arg - np.pi, arg)
            error[(error == OK) & deep & ((e < 0) | (e > 1))] = BAD_PERTURBED
            sin_i, cos_i = np.sin(ik), np.cos(ik)
            theta2 = cos_i**2
            x1mth2, x3thm1, x7thm1 = 1 - theta2, 3 * theta2 - 1, 7 * theta2 - 1
        # long-period terms
        ax = e * np.cos(arg)
        inv = 1 / (am * (1 - e**2))
        slope = np.where(np.abs(cos_i + 1) > 1.5e-12, 1 + cos_i, 1.5e-12)
        ay = e * np.sin(arg) - 0.5 * J3 / J2 * sin_i * inv
        big_l = m + arg + node - 0.25 * J3 / J2 * sin_i * (3 + 5 * cos_i) / slope * inv * ax
        # Kepler's equation
        uu = np.fmod(big_l - node, 2 * np.pi)
        eo = uu.copy()
        for _ in range(10):
            change = (uu - ay * np.cos(eo) + ax * np.sin(eo) - eo) / (1 - np.cos(eo) * ax - np.sin(eo) * ay)
            eo = eo + np.clip(change, -0.95, 0.95)
        sin_e, cos_e = np.sin(eo), np.cos(eo)
        e_cos, e_sin = ax * cos_e + ay * sin_e, ax * sin_e - ay * cos_e
        el2 = ax**2 + ay**2
        pl = am * (1 - el2)
        error[(error == OK) & (pl < 0)] = BAD_SEMI_LATUS
        r = am * (1 - e_cos)
        r_dot, rv_dot = np.sqrt(am) * e_sin / r, np.sqrt(pl) / r
        beta_l = np.sqrt(1 - el2)
        part = e_sin / (1 + beta_l)
        sin_u, cos_u = am / r * (sin_e - ay - ax * part), am / r * (cos_e - ax + ay * part)
        su = np.arctan2(sin_u, cos_u)
        sin2u, cos2u = 2 * cos_u * sin_u, 1 - 2 * sin_u**2
        j, j_p = 0.5 * J2 / pl, 0.5 * J2 / pl**2
        # short-period terms
        rk = r * (1 - 1.5 * j_p * beta_l * x3thm1) + 0.5 * j * x1mth2 * cos2u
        su = su - 0.25 * j_p * x7thm1 * sin2u
        node = node + 1.5 * j_p * cos_i * sin2u
        ik = ik + 1.5 * j_p * cos_i * sin_i * cos2u
        r_dot = r_dot - n * j * x1mth2 * sin2u / KE
        rv_dot = rv_dot + n * j * (x1mth2 * cos2u + 1.5 * x3thm1) / KE
        sin_su, cos_su, sin_n, cos_n, sin_k, cos_k = np.sin(su), np.cos(su), np.sin(node), np.cos(node), np.sin(ik), np.cos(ik)
        mx, my = -sin_n * cos_k, cos_n * cos_k
        up = np.stack([mx * sin_su + cos_n * cos_su, my * sin_su + sin_n * cos_su, sin_k * sin_su], axis=1)
        vp = np.stack([mx * cos_su - cos_n * sin_su, my * cos_su - sin_n * sin_su, sin_k * cos_su], axis=1)
        error[(error == OK) & (rk < 1)] = DECAYED
        position = (rk * RADIUS)[:, None] * up
        velocity = (RADIUS * KE / 60.0) * (r_dot[:, None] * up + rv_dot[:, None] * vp)
    position[error != OK] = velocity[error != OK] = np.nan
    return position, velocity, error


def radial_along_cross(position, velocity, difference):
    """Components of `difference` along the radius, the track and the orbit's normal."""
    r, v = np.asarray(position, float), np.asarray(velocity, float)
    radial = r / np.linalg.norm(r, axis=1, keepdims=True)
    normal = np.cross(r, v)
    normal = normal / np.linalg.norm(normal, axis=1, keepdims=True)
    along = np.cross(normal, radial)
    return tuple(np.einsum("ij,ij->i", np.asarray(difference, float), axis) for axis in (radial, along, normal))


FRAME = T.StructType([T.StructField(c, T.DoubleType()) for c in ("radial_km", "along_track_km", "cross_track_km")])


def _frame(position: pd.DataFrame, velocity: pd.DataFrame, difference: pd.DataFrame) -> pd.DataFrame:
    with np.errstate(all="ignore"):
        made = radial_along_cross(*(d.to_numpy(float, na_value=np.nan) for d in (position, velocity, difference)))
    return pd.DataFrame(dict(zip(FRAME.fieldNames(), made, strict=True)))


#: Structs of three numbers (position, velocity, difference) to the difference in the frame of that orbit.
frame = F.pandas_udf(_frame, FRAME)

SCHEMA = T.StructType([*[T.StructField(c, T.DoubleType()) for c in ("span_hours", "radial_km", "along_track_km", "cross_track_km", "total_km")], T.StructField("error", T.IntegerType())])


def _disagreement(earlier: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
    minutes = (pd.to_datetime(later["epoch"]) - pd.to_datetime(earlier["epoch"])).dt.total_seconds().to_numpy() / 60.0
    days = lambda d: (pd.to_datetime(d["epoch"]) - pd.Timestamp("1949-12-31", tz=pd.to_datetime(d["epoch"]).dt.tz)).dt.total_seconds().to_numpy() / 86400.0
    args = lambda d, t: propagate(*(d[f].to_numpy(float, na_value=np.nan) for f in FIELDS[1:]), t, days(d))
    predicted, _, error_a = args(earlier, minutes)
    reference, velocity, error_b = args(later, np.zeros(len(later)))
    with np.errstate(all="ignore"):
        difference = predicted - reference
        radial, along, cross = radial_along_cross(reference, velocity, difference)
        total = np.linalg.norm(difference, axis=1)
    places = lambda x, n: np.where(np.isfinite(x), np.round(x, n), np.nan)
    return pd.DataFrame({"span_hours": places(minutes / 60.0, 3), "radial_km": places(radial, 4), "along_track_km": places(along, 4), "cross_track_km": places(cross, 4), "total_km": places(total, 4), "error": np.where(error_a != OK, error_a, error_b).astype("int32")})


#: (earlier, later) structs of `FIELDS` to the difference of both at the later epoch, in the later orbit's frame.
disagreement = F.pandas_udf(_disagreement, SCHEMA)
