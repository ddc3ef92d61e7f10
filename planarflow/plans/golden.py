"""Published numbers of classes, and the check of a summary against them."""

from __future__ import annotations

# Fixed values: (color-preserving, color-blind) numbers of strong drawing classes, crossing-pair flag classes and
# four-vertex flag classes.
COUNTS: dict[tuple[int, int], dict[str, tuple[int, int]]] = {
    (2, 2): {"strong": (2, 2), "crossing": (2, 2), "four": (2, 2)},
    (2, 3): {"strong": (6, 6), "crossing": (5, 5), "four": (4, 4)},
    (2, 4): {"strong": (40, 40), "crossing": (21, 21), "four": (11, 11)},
    (2, 5): {"strong": (394, 394), "crossing": (144, 144), "four": (33, 33)},
    (2, 6): {"strong": (5457, 5457), "crossing": (1697, 1697), "four": (144, 144)},
    (3, 3): {"strong": (177, 102), "crossing": (112, 70), "four": (18, 13)},
    (3, 4): {"strong": (14823, 14823), "crossing": (6393, 6393), "four": (355, 355)},
    (3, 5): {"strong": (2163813, 2163813), "crossing": (468742, 468742), "four": (17643, 17643)},
    (4, 4): {"strong": (18031850, 9019729), "crossing": (1931529, 967452), "four": (123926, 62415)},
}


def verdicts(summary: dict) -> list[tuple[str, str, object, object]]:
    """(PASS, FAIL or SKIP, field, found, published) for each count of a run's summary."""
    m, n = summary["m"], summary["n"]
    out = []
    for name, want in COUNTS.get((m, n), {}).items():
        got = summary.get(name)
        got = got and (got["color_preserving"], got["color_blind"])
        out.append(("SKIP" if got is None else "PASS" if got == want else "FAIL", name, got, want))
    return out
