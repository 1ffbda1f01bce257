import math

import numpy as np
import pytest

from tonelake.operators import spectra


def prominent(levels, rise):
    """Middles of the flat or sharp peaks whose way down to either side, before a higher point, is at least ``rise``."""
    out, i, n = [], 0, len(levels)
    while i < n:
        j = i
        while j + 1 < n and levels[j + 1] == levels[i]:
            j += 1
        if (i == 0 or levels[i - 1] < levels[i]) and (j == n - 1 or levels[j + 1] < levels[i]):
            fine = True
            for way in (range(i, -1, -1), range(j, n)):
                low, edge = levels[i], True
                for p in way:
                    if levels[p] > levels[i]:
                        edge = False
                        break
                    low = min(low, levels[p])
                fine = fine and (edge or levels[i] - low >= rise)
            if fine:
                out.append((i + j) // 2)
        i = j + 1
    return out


def brute(shape, outline, rise):
    """(group, grain) of every bin from the first that takes part."""
    x = [max(v, spectra.SHAPE_FLOOR) for v in shape[spectra.LOWEST_BIN :]]
    o = outline[spectra.LOWEST_BIN :]
    floor = spectra.OUTLINE_FLOOR * max(max(o), spectra.SHAPE_FLOOR)
    levels = [10 * math.log10(v + floor) for v in o]
    peaks = prominent(levels, rise)
    starts = {0} | {min(range(a, b), key=lambda p: (levels[p], p)) for a, b in zip(peaks, peaks[1:])}
    cuts = starts | {i for i in range(1, len(x) - 1) if x[i] <= x[i - 1] and x[i] < x[i + 1]}
    return [(sum(s <= i for s in starts) - 1, sum(c <= i for c in cuts) - 1) for i in range(len(x))]


def place(shape, cut, pieces):
    """Each grain of a piece's group read at its new bins, one value after the other."""
    out = np.zeros(len(shape))
    x = np.maximum(np.array(shape, float), spectra.SHAPE_FLOOR)
    for grp, gain, scale in pieces:
        for grain in sorted({n for g, n in cut if g == grp}):
            own = [i + spectra.LOWEST_BIN for i, (_, n) in enumerate(cut) if n == grain]
            energy = x[own].sum()
            shift = float((x[own] * own).sum() / energy) * (scale - 1)
            first, values = math.ceil(own[0] - 0.5 + shift), []
            for target in range(first, first + len(own)):
                near = min(max(round(target - shift), own[0]), own[-1])
                a, b, c = (math.log(x[min(max(p, own[0]), own[-1])]) for p in (near - 1, near, near + 1))
                off = target - shift - near
                values.append(math.exp(b + off * (c - a) / 2 + off * off * (c - 2 * b + a) / 2))
            for target, v in zip(range(first, first + len(own)), values):
                if spectra.LOWEST_BIN <= target < len(shape):
                    out[target] += v * gain * energy / sum(values)
    return out


def table(spark, frames):
    rows = [(f, i, float(s), float(o), "x") for f, (shape, outline) in frames.items() for i, (s, o) in enumerate(zip(shape, outline))]
    return spark.createDataFrame(rows[::-1], "f string, b int, s double, o double, grp string")


def frames():
    rng = np.random.default_rng(4)
    out = {f"steps {n}": (rng.integers(0, 5, n), rng.integers(0, 4, n)) for n in (2, 3, 9, 40, 200)}  # many flat peaks and ties
    out |= {f"noise {n}": (rng.random(n) ** 4, np.convolve(rng.random(n), np.ones(5) / 5, "same")) for n in (5, 64, 300)}
    lobes = sum(np.exp(-0.5 * ((np.arange(128) - c) / 2.5) ** 2) for c in (20, 41, 90))
    return out | {"lobes": (lobes, lobes), "silence": (np.zeros(12), np.zeros(12)), "flat": (np.ones(12), np.ones(12))}


@pytest.mark.parametrize("rise", [0.5, 3.0, 30.0])
def test_cut_as_by_hand(spark, rise):
    got = {}
    for r in spectra.segmented(table(spark, frames()), "f", "b", "s", "o", rise).collect():
        got.setdefault(r.frame, {})[r.bin] = (r.grp, r.grain)
    for name, (shape, outline) in frames().items():
        want = brute(list(map(float, shape)), list(map(float, outline)), rise)
        assert [got[name][i] for i in sorted(got[name])] == want, name


def test_lobes_make_groups_that_hold_their_energy(spark):
    cut = spectra.segmented(table(spark, frames()), "f", "b", "s", "o", 6.0)
    out = {r.grp: r for r in spectra.groups(spectra.grains(cut)).where("frame = 'lobes'").collect()}
    assert [round(out[g].center) for g in range(3)] == [20, 41, 90]
    assert sum(r.energy for r in out.values()) == pytest.approx(frames()["lobes"][0][1:].sum())


def test_placed_as_by_hand(spark):
    data = frames()
    cut = spectra.segmented(table(spark, data), "f", "b", "s", "o", 3.0)
    pieces = [(0, 0.5, 1.25), (0, 0.5, 1.25), (0, 1.0, 1.0), (1, 2.0, 0.7), (2, 1.0, 40.0), (99, 1.0, 1.0)]
    moves = spark.createDataFrame([(f, *p) for f in data for p in pieces] + [("lobes", 0, None, 1.0), ("none", 0, 1.0, 1.0)], "frame string, grp long, gain double, scale double")
    got = {}
    for r in spectra.placed(cut, moves).collect():
        got.setdefault(r.frame, {})[r.bin] = r.energy
    assert "none" not in got
    for name, (shape, outline) in data.items():
        want = place(list(map(float, shape)), brute(list(map(float, shape)), list(map(float, outline)), 3.0), pieces)
        assert np.allclose([got[name].get(i, 0.0) for i in range(len(shape))], want, rtol=1e-9, atol=1e-12), name


def test_nothing_moved_gives_the_shape_back(spark):
    cut = spectra.segmented(table(spark, frames()), "f", "b", "s", "o", 3.0)
    same = cut.selectExpr("frame", "grp", "1.0D as gain", "1.0D as scale").distinct()
    off = spectra.placed(cut, same).join(cut, ["frame", "bin"], "full").selectExpr("max(abs(energy - shape) / shape) as off", "count_if(energy is null or shape is null) as lost").first()
    assert off["off"] < 1e-9 and off["lost"] == 0


def test_missing_values_and_empty_tables(spark):
    odd = [("a", 1, 1.0, 1.0), ("a", 2, None, None), ("a", 3, float("nan"), float("nan")), ("a", 4, -2.0, -1.0), ("a", 5, 1.0, 1.0), (None, 1, 1.0, 1.0), ("a", None, 1.0, 1.0), ("a", 0, 9.0, 9.0)]
    rows = spark.createDataFrame(odd, "f string, b int, s double, o double")
    got = [(r.bin, r.shape, r.grp, r.grain) for r in spectra.segmented(rows, "f", "b", "s", "o", 3.0).orderBy("bin").collect()]
    low = spectra.SHAPE_FLOOR
    assert got == [(1, 1.0, 0, 0), (2, low, 1, 1), (3, low, 1, 1), (4, low, 1, 2), (5, 1.0, 1, 2)]
    none = spectra.segmented(rows.limit(0), "f", "b", "s", "o", 3.0)
    assert none.count() == 0 and spectra.groups(spectra.grains(none)).count() == 0
