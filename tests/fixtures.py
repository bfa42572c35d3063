"""Small demand tables made by our own code."""
import datetime as dt

import numpy as np
import pandas as pd

EPOCH = "2011-01-01"


def demand_table(seed=0, days=60, drop=0.06):
    """Hourly rows with a known shape: day type x hour, temperature, weather, growth; gaps and humidity faults planted."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(days):
        day = dt.date(2011, 1, 1) + dt.timedelta(days=i * 6)
        wk = (day.weekday() + 1) % 7
        holiday = int(i == 7)
        work = int(1 <= wk <= 5 and not holiday)
        for hr in range(24):
            if rng.random() < drop and hr not in (8, 17):
                continue
            temp = 0.5 + 0.3 * np.sin(2 * np.pi * (day.timetuple().tm_yday - 100) / 365) + 0.05 * rng.normal()
            ws = int(rng.choice([1, 2, 3], p=[0.6, 0.3, 0.1]))
            hum = 0.0 if i == 11 else float(np.clip(rng.normal(0.6, 0.15), 0.05, 1))
            mean = np.exp(2.0 + 1.5 * temp + (1.2 if work and hr in (8, 17) else 0) + (0.6 if 9 <= hr <= 20 else 0) - 0.3 * (ws - 1) + 0.0005 * i * 6)
            rows.append(dict(instant=i * 6 * 24 + hr + 1, dteday=day, season=(day.month - 1) // 3 + 1, yr=day.year - 2011, mnth=day.month, hr=hr,
                             holiday=holiday, weekday=wk, workingday=work, weathersit=ws, temp=float(temp), atemp=float(temp * 0.95 + 0.01 * rng.normal()),
                             hum=hum, windspeed=float(max(0, rng.normal(0.2, 0.15))), cnt=int(1 + rng.poisson(mean)), hour_idx=(day - dt.date(1970, 1, 1)).days * 24 + hr))
    return pd.DataFrame(rows)


def memory_by_hand(pdf):
    """Weather memory of every row by looking each hour up."""
    known = {}
    for t, w in zip(pdf.hour_idx, np.minimum(pdf.weathersit, 3)):
        known.setdefault(t, w)
    own = np.minimum(pdf.weathersit, 3)
    back = [[known.get(t - h, w) for t, w in zip(pdf.hour_idx, own)] for h in (1, 2, 3)]
    return np.array(back[0]), np.max(back, axis=0)


def reference_fit(spec, fit, new, target, alpha=1e-8, names=None):
    """Plain numpy version of design, least squares, back-transform and prediction."""
    from hourwise.plans.spec import factors
    fill = np.median(fit.hum[fit.hum > 0])

    def raw(d):
        c = {f"hr_{h}": d.hr == h for h in range(1, 24)}
        ws = np.minimum(d.weathersit, 3)
        for n in ("workingday", "holiday", "temp", "windspeed", "atemp", "yr", "instant"):
            c[n] = d[n]
        for k in (2, 3):
            c[f"ws_{k}"], c[f"wslag1_{k}"], c[f"wet3_{k}"] = ws == k, d.ws_lag1 == k, d.wet3 == k
        c["hum"] = np.where(d.hum == 0, fill, d.hum)
        day = pd.to_datetime(d.dteday)
        c["trend"] = (day - pd.Timestamp(EPOCH)).dt.days
        for k in (1, 2):
            a = 2 * np.pi * k * day.dt.dayofyear / 365.25
            c[f"doy_s{k}"], c[f"doy_c{k}"] = np.sin(a), np.cos(a)
        for k in range(2, 13):
            c[f"mn_{k}"] = d.mnth == k
        for k in range(2, 5):
            c[f"se_{k}"] = d.season == k
        for k in range(1, 7):
            c[f"wk_{k}"] = d.weekday == k
        return {n: np.asarray(c[n], float) for n in spec.first_order}

    def scaled(a, b):
        s = a.std()
        s = s if s > 1e-12 else 1.0
        return (a - a.mean()) / s, (b - a.mean()) / s
    rf, rn = raw(fit), raw(new)
    zf, zn, cf, cn = {}, {}, {}, {}
    for n in spec.first_order:
        zf[n], zn[n] = cf[n], cn[n] = scaled(rf[n], rn[n])
    for t in spec.derived:
        parts = factors(t).items()
        cf[t], cn[t] = scaled(np.prod([zf[c] ** k for c, k in parts], axis=0), np.prod([zn[c] ** k for c, k in parts], axis=0))
    use = spec.names[1:] if names is None else names
    X = np.column_stack([np.ones(len(fit))] + [cf[n] for n in use])
    Xn = np.column_stack([np.ones(len(new))] + [cn[n] for n in use])
    y = fit.cnt.to_numpy(float)
    z = target.forward_np(y)
    w = np.linalg.solve(X.T @ X / len(z) + np.diag([0.0] + [alpha] * (X.shape[1] - 1)), X.T @ z / len(z))
    q = target.inverse_np(X @ w)
    s = ((y + 1) * q).sum() / (q * q).sum()
    pred = np.maximum(s * target.inverse_np(np.minimum(Xn @ w, target.cap(y.max()))) - 1, 0)
    return w, s, pred, X, Xn


def r2(y, p):
    y = np.asarray(y, float)
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
