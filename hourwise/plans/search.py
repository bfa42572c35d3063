"""Searches over plans, penalties and columns. Each one lists all its candidate models first and scores them together."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from hourwise.operators.selection import ORIGINAL, partners, sources_of
from hourwise.plans import solvers
from hourwise.plans.lab import Lab, Model, fold_paths, three_validators
from hourwise.plans.spec import DesignSpec

UNPENALISED = 1e-8


def best_of(alphas: Sequence[float], scores: Sequence[float]) -> int:
    """Highest score; an exact tie takes the larger penalty."""
    return max(range(len(alphas)), key=lambda i: (scores[i], alphas[i]))


def smallest_within(rows: list[dict], score: str, size: str, tol: float) -> dict:
    """Smallest row whose score is within tol of the best; the first of equals."""
    top = max(r[score] for r in rows)
    return min((r for r in rows if r[score] >= top - tol), key=lambda r: r[size])


def penalty_grid(lab: Lab, spec: DesignSpec, power: float, rho: float, n: int, names=None, ridge_range=(1e-6, 1e3), ratio: float = 1e-4,
                 set_name: str = "train") -> np.ndarray:
    """Descending penalties: a fixed range for ridge, from the smallest all-zero penalty down otherwise."""
    if rho == 0.0:
        return np.geomspace(ridge_range[1], ridge_range[0], n)
    _, gram, cross, _ = lab.normal_equations(spec, set_name, power, names)
    return solvers.penalty_grid(solvers.largest_alpha(solvers.centred(gram, cross)[1], rho), ratio, n)


METHODS = {"l2": (0.0,), "l1": (1.0,), "enet": (0.1, 0.3, 0.5, 0.7, 0.9, 0.95)}


def penalty_search(lab: Lab, spec: DesignSpec, power: float, k: int, n_alphas: int = 40, methods: dict[str, Sequence[float]] = METHODS,
                   names: Sequence[str] | None = None, draws: int = 200, seed: int = 0, ratio: float = 1e-4) -> dict:
    """Curves, cross-validation on whole days, chosen models, paired comparisons and the recommended method.

    One scoring pass serves the validation curves of every l1 ratio, a second the chosen models with their bootstrap."""
    grids = {rho: penalty_grid(lab, spec, power, rho, n_alphas, names, ratio=ratio) for rhos in methods.values() for rho in rhos}
    curve_models = {rho: lab.penalised(f"curve|{rho}", spec, "train", power, grid, rho, names) for rho, grid in grids.items()}
    curve_scores = lab.evaluate([m for ms in curve_models.values() for m in ms])
    curves, chosen = [], {}
    for method, rhos in methods.items():
        options = []
        for rho in rhos:
            rows = [{"method": method, "rho": rho, "alpha": m.info["alpha"], "n_nonzero": m.info["n_nonzero"],
                     "val_r2": curve_scores.r2(m.name, "val"), "val_rmse": curve_scores.metrics(m.name, "val")["rmse"],
                     "train_r2": curve_scores.r2(m.name, "train")} for m in curve_models[rho]]
            curves += rows
            i = best_of([r["alpha"] for r in rows], [r["val_r2"] for r in rows])
            options.append((rows[i]["val_r2"], -len(options), rho, i))
        _, _, rho, i = max(options)
        chosen[method] = (rho, i)
    cv_grids = {rho: grids[rho] for rho, _ in chosen.values()}
    fold_models = fold_paths(lab, spec, power, cv_grids, k, names)
    fold_scores = lab.evaluate(fold_models)
    cv = [{"rho": m.info["rho"], "alpha": m.info["alpha"], "fold": m.info["fold"], "score": fold_scores.r2(m.name, f"held{m.info['fold']}")} for m in fold_models]

    final: dict[str, Model] = {}
    chrono = {}
    for method, (rho, i) in chosen.items():
        final[method] = curve_models[rho][i]
        alphas = grids[rho][:i + 1] if rho else grids[rho][i:i + 1]
        chrono[method] = lab.penalised(f"chrono|{method}", spec, "early", power, alphas, rho, names)[-1]
    plain = lab.least_squares("unpenalised", spec, "train", power, UNPENALISED, names)
    scores = lab.evaluate([*final.values(), *chrono.values(), plain], draws=draws, draw_set="val", seed=seed)
    rows = []
    for method, (rho, i) in chosen.items():
        m = final[method]
        day = [c["score"] for c in cv if c["rho"] == rho and np.isclose(c["alpha"], grids[rho][i], rtol=1e-9)]
        lo, hi, _ = scores.interval(m.name)
        va, late = scores.metrics(m.name, "val"), scores.metrics(chrono[method].name, "late")
        rows.append({"method": method, "rho": rho, "alpha": float(grids[rho][i]), "val_r2": va["r2"], "val_rmse": va["rmse"], "val_lo": lo, "val_hi": hi,
                     "train_r2": scores.r2(m.name, "train"), "n_nonzero": m.info["n_nonzero"], "day_r2": float(np.mean(day)),
                     "day_se": float(np.std(day, ddof=1) / np.sqrt(len(day))), "chrono_r2": late["r2"], "chrono_rmse": late["rmse"]})
    pairs = []
    order = list(methods)
    for a in order:
        for b in order[:order.index(a)]:
            pairs.append({"a": a, "b": b, **scores.paired(final[a].name, final[b].name, "val")})
        pairs.append({"a": a, "b": "unpenalised", **scores.paired(final[a].name, plain.name, "val")})
    best = max(rows, key=lambda r: r["val_r2"])
    tied = []
    for r in rows:
        d = scores.paired(final[r["method"]].name, final[best["method"]].name, "val")
        if r is best or d["lo"] <= 0.0 <= d["hi"]:
            tied.append(r)
    pick = max(tied, key=lambda r: r["day_r2"])
    for r in rows:
        r["tied"], r["recommended"] = r in tied, r is pick
    return {"curves": curves, "cv": cv, "methods": rows, "comparisons": pairs, "models": final, "recommended": pick, "grids": grids}


def column_evidence(lab: Lab, spec: DesignSpec, power: float, alpha: float, k: int, draws: int, seed: int) -> list[dict]:
    """What each original column is worth: cost of dropping it alone, with its partners and on held-out days, its score
    alone, its closest other column and its inflation. Every refit is a sub-matrix of the same sums."""
    names = spec.names[1:]
    behind = {n: sources_of(n) for n in names}
    present = [c for c in ORIGINAL if any(c in s for s in behind.values())]

    def fit(tag, keep, set_name="train"):
        return lab.penalised(tag, spec, set_name, power, [alpha], 0.0, keep)[0] if keep else None

    models: dict[str, Model | None] = {"full": fit("full", names)}
    for g in range(k):
        models[f"full|{g}"] = fit(f"full{g}", names, f"fit{g}")
    for c in present:
        without = [n for n in names if c not in behind[n]]
        models[f"alone|{c}"] = fit(f"alone:{c}", without)
        for g in range(k):
            models[f"alone|{c}|{g}"] = fit(f"alone{g}:{c}", without, f"fit{g}")
        mates = {c, *partners(c)}
        if len(mates) > 1:
            models[f"group|{c}"] = fit(f"group:{c}", [n for n in names if not behind[n] & mates])
        models[f"solo|{c}"] = fit(f"solo:{c}", [n for n in names if behind[n] == {c}])
    scores = lab.evaluate([m for m in models.values() if m is not None], draws=draws, draw_set="val", seed=seed)
    _, gram, cross, _ = lab.normal_equations(spec, "train", power)
    corr = np.abs(solvers.correlation(solvers.centred(gram, cross)[0]))
    first = [i for i, n in enumerate(names) if "*" not in n and "^" not in n]
    first_corr = solvers.correlation(solvers.centred(gram, cross)[0])[np.ix_(first, first)]
    out = []
    for c in present:
        alone = scores.paired(models["full"].name, models[f"alone|{c}"].name, "val")
        day = [scores.r2(models[f"full|{g}"].name, f"held{g}") - scores.r2(models[f"alone|{c}|{g}"].name, f"held{g}") for g in range(k)]
        group = models.get(f"group|{c}")
        g = scores.paired(models["full"].name, group.name, "val") if group is not None else {}
        solo = models[f"solo|{c}"]
        own = [i for i, n in enumerate(names) if behind[n] == {c}]
        other = [i for i, n in enumerate(names) if len(behind[n]) == 1 and c not in behind[n]]
        value, mate = 0.0, None
        if own and other:
            block = corr[np.ix_(own, other)].max(axis=0)
            j = int(block.argmax())
            value, mate = float(block[j]), next(iter(behind[names[other[j]]]))
        mine = [q for q, i in enumerate(first) if behind[names[i]] == {c}]
        out.append({"column": c, **alone, "day_delta": float(np.mean(day)), "group_delta": g.get("delta"), "group_lo": g.get("lo"), "group_hi": g.get("hi"),
                    "solo_r2": scores.r2(solo.name, "val") if solo is not None else None, "max_abs_corr": value, "corr_with": mate,
                    "vif_max": max((solvers.inflation(first_corr, q) for q in mine), default=None)})
    return out


def pick_block(gains: dict[str, tuple[float, float, float]], least_gain: float, chrono_loss: float) -> str | None:
    """The block to add among name -> (mean gain over the folds, its standard error, change of the chronological score): of
    those whose gain exceeds two standard errors and `least_gain` and whose chronological score falls by `chrono_loss` at
    most, the one with the largest gain."""
    fit = [n for n, (gain, se, change) in gains.items() if gain > 2 * se and gain > least_gain and change >= -chrono_loss]
    return max(fit, key=lambda n: gains[n][0], default=None)


def greedy_blocks(lab: Lab, start: DesignSpec, candidates: dict[str, DesignSpec], power: float, k: int, chrono_loss: float = 0.003,
                  least_gain: float = 0.0005, merge=None) -> list[dict]:
    """Forward selection by `pick_block`, until no candidate passes; the last row is the best that failed."""
    def score(plans: dict[str, DesignSpec]) -> dict[str, dict]:
        return {r["name"]: r for r in three_validators(lab, {n: (p, power) for n, p in plans.items()}, k)}

    def row(step: int, name: str, r: dict, gain: float, se: float, accepted: bool) -> dict:
        return {"step": step, "block": name, "day_r2": r["day_r2"], "chrono_r2": r["chrono_r2"], "gain": gain, "se": se, "accepted": accepted}
    plan, now, left = start, score({"start": start})["start"], dict(candidates)
    out = [row(0, "start", now, 0.0, 0.0, True)]
    while left:
        plans = {n: merge(plan, c) for n, c in left.items()}
        scored = score(plans)
        gains = {}
        for n, r in scored.items():
            d = np.subtract(r["folds"], now["folds"])
            gains[n] = float(d.mean()), float(d.std(ddof=1) / np.sqrt(k)), r["chrono_r2"] - now["chrono_r2"]
        name = pick_block(gains, least_gain, chrono_loss)
        shown = name if name is not None else max(gains, key=lambda n: gains[n][0])
        out.append(row(len(out), shown, scored[shown], *gains[shown][:2], name is not None))
        if name is None:
            break
        plan, now = plans[name], scored[name]
        del left[name]
    return out
