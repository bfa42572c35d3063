"""Feature plans: which first-order columns, powers and products a design holds, and their names in order."""
from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable
from itertools import product

HOURS = tuple(f"hr_{h}" for h in range(1, 24))
SEASONS = tuple(f"se_{k}" for k in range(2, 5))
MONTHS = tuple(f"mn_{k}" for k in range(2, 13))
WEEKDAYS = tuple(f"wk_{k}" for k in range(1, 7))
SITUATIONS = ("ws_2", "ws_3")
YEAR_WAVES = ("doy_s1", "doy_c1", "doy_s2", "doy_c2")
MEMORY = ("wslag1_2", "wslag1_3", "wet3_2", "wet3_3")
BASE = HOURS + ("workingday", "holiday") + SITUATIONS + ("temp", "hum", "windspeed", "trend") + YEAR_WAVES
CANDIDATES = ("atemp", "yr", "instant") + SEASONS + MONTHS + WEEKDAYS + MEMORY
REGISTRY = BASE + CANDIDATES


def _products(*axes: Iterable[str]) -> tuple[str, ...]:
    return tuple("*".join(names) for names in product(*axes))


# Names, order and members of the blocks, of the registry above and of the levels below, as stored plans use them.
# A block is a list of terms: a plain name adds a first-order column, a^k a power, a*b*c a product.
BLOCKS: dict[str, tuple[str, ...]] = {
    "wd_x_hr": _products(["workingday"], HOURS), "hr_x_temp": _products(HOURS, ["temp"]),
    "hr_x_hum": _products(HOURS, ["hum"]), "wk": WEEKDAYS, "wk_x_hr": _products(WEEKDAYS, HOURS),
    "wd_x_hr_x_temp": _products(["workingday"], HOURS, ["temp"]), "hr_x_ws": _products(HOURS, SITUATIONS),
    "wd_x_wx": _products(["workingday"], ("temp", "hum") + SITUATIONS),
    "hr_x_doy": _products(HOURS, ["doy_s1", "doy_c1"]), "hr_x_trend": _products(HOURS, ["trend"]),
    "mn": MONTHS, "mn_x_hr": _products(MONTHS, HOURS), "mn_x_wd_x_hr": _products(MONTHS, ["workingday"], HOURS),
    "c_atemp": ("atemp",), "c_yr": ("yr",), "c_instant": ("instant",), "c_season": SEASONS, "c_mnth": MONTHS,
    "c_weekday": WEEKDAYS, "wx_detail": ("hum^2", "hum^3", "windspeed^2", "temp*windspeed"), "ws_memory": MEMORY}


def factors(term: str) -> dict[str, int]:
    """Column -> power of a term."""
    out: dict[str, int] = {}
    for part in term.split("*"):
        name, _, power = part.partition("^")
        out[name] = out.get(name, 0) + int(power or 1)
    return out


_Parts = namedtuple("_Parts", "base power_cols degree blocks own")


class DesignSpec(_Parts):
    """A feature plan: first-order columns, columns raised up to `degree`, blocks of terms, and `own`, the names of user
    columns that the caller supplies as Column expressions. A name that nothing defines is an error."""
    __slots__ = ()

    def __new__(cls, base: Iterable[str] = BASE, power_cols: Iterable[str] = (), degree: int = 1, blocks: Iterable[str] = (), own: Iterable[str] = ()):
        made = super().__new__(cls, *map(tuple, (base, power_cols)), degree, *map(tuple, (blocks, own)))
        columns = {*REGISTRY, *made.own}
        problems = [f"no column {c}" for c in (*made.base, *made.power_cols) if c not in columns] + [f"no block {b}" for b in made.blocks if b not in BLOCKS]
        if degree < 1:
            problems.append(f"degree {degree} is below 1")
        if problems:
            raise ValueError("; ".join(problems))
        return made

    def to_dict(self) -> dict:
        """Plain lists and numbers, as stored with a model."""
        return {part: value if part == "degree" else [*value] for part, value in self._asdict().items()}

    @classmethod
    def from_dict(cls, stored: dict) -> DesignSpec:
        return cls(*(stored[part] for part in cls._fields))

    def with_blocks(self, *names: str) -> DesignSpec:
        return DesignSpec(**self._asdict() | {"blocks": self.blocks + names})

    @property
    def terms(self) -> list[str]:
        powers = [f"{c}^{k}" for c in self.power_cols for k in range(2, self.degree + 1)]
        return powers + [t for b in self.blocks for t in BLOCKS[b]]

    @property
    def first_order(self) -> list[str]:
        """The base, then what powers and blocks need, in registry order, then the user's own columns."""
        needed = set(self.power_cols).union(*(factors(t) for t in self.terms))
        return (list(self.base) + [c for c in REGISTRY if c in needed and c not in self.base]
                + [c for c in self.own if c not in self.base])

    @property
    def derived(self) -> list[str]:
        """Powers and products in order, each name once."""
        return list(dict.fromkeys(t for t in self.terms if "*" in t or "^" in t))

    @property
    def names(self) -> list[str]:
        return ["bias"] + self.first_order + self.derived


def append_blocks(spec: DesignSpec, candidates: Iterable[str]) -> tuple[DesignSpec, list[str], list[str]]:
    """Add each block that brings a new column: (plan, added, skipped)."""
    added, skipped = [], []
    for block in candidates:
        bigger = spec.with_blocks(block)
        if set(bigger.names) <= set(spec.names):
            skipped.append(block)
        else:
            spec = bigger
            added.append(block)
    return spec, added, skipped


# The nested levels of the complexity ladder.
LADDER = (("C0_no_hour", ()), ("C1_additive", ()), ("C2_wd_x_hr", ("wd_x_hr",)), ("C3_anchor", ()),
          ("C4_hr_x_weather", ("hr_x_temp", "hr_x_hum")), ("C5_weekday_x_hr", ("wk", "wk_x_hr")),
          ("C6_weather_detail", ("wx_detail", "wd_x_hr_x_temp", "ws_memory")), ("C7_fine_weather", ("hr_x_ws", "wd_x_wx")),
          ("C8_hr_x_time", ("hr_x_doy", "hr_x_trend")), ("C9_month_x_hr", ("mn", "mn_x_hr")),
          ("C10_month_x_wd_x_hr", ("mn_x_wd_x_hr",)))
ANCHOR = DesignSpec(BASE, ("temp",), 3, ("wd_x_hr",))


def ladder(anchor: DesignSpec = ANCHOR, levels=LADDER, anchor_level: str = "C3_anchor") -> list[tuple[str, DesignSpec]]:
    """Cumulative plans: degree 1 before the anchor, the anchor itself, then the anchor extended."""
    out, blocks, past = [], [], False
    for name, add in levels:
        blocks += [b for b in add if b not in blocks]
        if name == anchor_level:
            spec, past = anchor, True
        elif past:
            spec = anchor.with_blocks(*[b for b in blocks if b not in anchor.blocks])
        else:
            base = tuple(c for c in BASE if c not in HOURS) if name == "C0_no_hour" else BASE
            spec = DesignSpec(base, blocks=tuple(blocks))
        out.append((name, spec))
    return out
