"""build_matching against a plain version of its rules, and the rules one by one."""

import hashlib
import math

import numpy as np
import pytest

from cohortloom.operators import matching, neighbours


def items_of(seed, n=260, families=3, subjects=5, sequences=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        label = int(rng.random() < 0.45)
        subject = f"{'sick' if label else 'norm'}{rng.integers(0, subjects)}"
        h = int(rng.integers(-(2**62), 2**62)) if k % 9 else int(2**62 - 1)
        rows.append((k, subject, f"{subject}/{rng.integers(0, sequences)}", label, h if k % 29 else None, int(k % 17 > 0), int(k % 19 > 0), None if k % 2 else 1, float(rng.random() * 0.5 + 0.001), float(rng.random()), float(rng.random()) if k % 7 else None, float(rng.random() * 0.2), float(rng.random()), float(rng.random() * 90), float(rng.random()), float(rng.random() * 200), k % 23 > 0, int(rng.integers(0, families))))
    return rows


SCHEMA = "item long, subject string, sequence string, label int, hash long, quality_valid int, attention_valid int, heart_present int, area double, centroid_x double, centroid_y double, boundary double, position double, sharpness double, noise double, spread double, has_mask boolean, family long"


def reason(r):
    tests = [("quality_invalid", r["quality_valid"] != 1), ("attention_invalid", r["attention_valid"] != 1), ("heart_not_visible", r["heart_present"] not in (None, 1)), ("attention_area_too_small", r["area"] < 0.003), ("missing_phash", r["hash"] is None), ("missing_attention_mask", not r["has_mask"])]
    return ";".join(n for n, bad in tests if bad)


def described(rows):
    signs = np.array([[1 if (r["hash"] >> (63 - b)) & 1 else -1 for b in range(64)] for r in rows]) * math.sqrt(0.45 / 64)
    parts = [signs]
    for columns, weight in ((("area", "centroid_x", "centroid_y", "boundary"), 0.25), (("position",), 0.15), (("log_sharpness", "noise", "spread"), 0.15)):
        for c in columns:
            x = np.array([np.nan if (v := (math.log1p(r["sharpness"]) if c == "log_sharpness" else r[c])) is None else v for r in rows], float)
            m = np.nanmedian(x)
            s = max(1e-3, 1.4826 * np.nanmedian(np.abs(x - m)))
            parts.append(np.clip(np.where(np.isnan(x), 0, (x - m) / s), -5, 5)[:, None] * math.sqrt(weight / len(columns)))
    return np.hstack(parts)


def plain_caliper(d, k, q):
    d = np.array(d)
    m = np.median(d)
    return max(m, min(m + k * max(1e-9, 1.4826 * np.median(np.abs(d - m))), np.quantile(d, q)))


def plain(rows):
    """(pairs with ids, reasons) by loops over dictionaries."""
    why = {r["item"]: reason(r) for r in rows}
    ok = [r for r in rows if not why[r["item"]]]
    x = {r["item"]: v for r, v in zip(ok, described(ok), strict=True)}
    by = {r["item"]: r for r in ok}
    fams = {}
    for r in ok:
        fams.setdefault(r["family"], ([], []))[r["label"]].append(r["item"])
    shared = {f for f, sides in fams.items() if all(len(s) >= 12 and len({by[i]["subject"] for i in s}) >= 2 for s in sides)}
    n = [sum(r["label"] == c for r in ok) for c in (0, 1)]
    target = max(1, min(round(len(ok) * 0.25), min(n)))
    caps = {c: max(60, math.ceil(target / len({r["subject"] for r in ok if r["label"] == c}) * 1.7)) for c in (0, 1)}
    edges, cal = {}, {}
    for f in sorted(shared):
        normal, sick = fams[f]
        dist = {(s, m): round(float(np.sqrt(((x[s] - x[m]) ** 2).sum())), 9) for s in sick for m in normal}
        rs = {(s, m): k + 1 for s in sick for k, m in enumerate(sorted(normal, key=lambda m: (dist[s, m], m))[:12])}
        rn = {(s, m): k + 1 for m in normal for k, s in enumerate(sorted(sick, key=lambda s: (dist[s, m], s))[:12])}
        found = []
        for s, m in {*rs, *rn}:
            if abs(by[s]["position"] - by[m]["position"]) > 0.25 or abs(by[s]["area"] - by[m]["area"]) > 0.2:
                continue
            a, b = rs.get((s, m)), rn.get((s, m))
            tie = hashlib.sha256(f"{f}|{s}|{m}".encode()).hexdigest()
            found.append({"s": s, "m": m, "d": dist[s, m], "a": a, "b": b, "both": a is not None and b is not None, "core": bool(a and b and a <= 5 and b <= 5), "tie": tie, "f": f})
        edges[f] = found
        core = [e["d"] for e in found if e["core"]]
        wide = plain_caliper([e["d"] for e in found], 3.5, 0.97) if found else math.nan
        c = plain_caliper(core, 2.5, 0.9) if core else math.nan
        cal[f] = (c, wide if math.isnan(c) else max(c, min(wide, 1.18 * c)))
    used, pf, sf, total, pp, sp, pairs, seeds = set(), {}, {}, {}, {}, {}, [], set()
    get = lambda d, k: d.get(k, 0)

    def fits(e, core, quota=None):
        s, m = by[e["s"]], by[e["m"]]
        if e["s"] in used or e["m"] in used:
            return False
        lim = (20, 5) if core else (60, 15)
        if any(get(pf, (r["subject"], e["f"])) >= lim[0] or get(sf, (r["sequence"], e["f"])) >= lim[1] for r in (s, m)):
            return False
        if core:
            return True
        if get(pp, (s["subject"], m["subject"])) >= 60 or get(sp, (s["sequence"], m["sequence"])) >= 12:
            return False
        for r in (s, m):
            have = total.setdefault(r["subject"], 0)
            if have >= caps[r["label"]] or (quota is not None and have >= quota):
                return False
        return True

    def take(e, stage):
        s, m = by[e["s"]], by[e["m"]]
        used.update((e["s"], e["m"]))
        for r in (s, m):
            pf[r["subject"], e["f"]] = get(pf, (r["subject"], e["f"])) + 1
            sf[r["sequence"], e["f"]] = get(sf, (r["sequence"], e["f"])) + 1
            total[r["subject"]] = get(total, r["subject"]) + 1
        pp[s["subject"], m["subject"]] = get(pp, (s["subject"], m["subject"])) + 1
        sp[s["sequence"], m["sequence"]] = get(sp, (s["sequence"], m["sequence"])) + 1
        if stage == "CORE":
            seeds.add((s["sequence"], m["sequence"]))
        pairs.append((e["s"], e["m"], stage, f"CCM_{stage}_F{e['f']:02d}_P{len(pairs) + 1:06d}"))

    for f in sorted(shared):
        for e in sorted((e for e in edges[f] if e["core"]), key=lambda e: (e["d"], e["tie"])):
            if e["d"] <= cal[f][0] and fits(e, True):
                take(e, "CORE")
    left = max(0, target - len(pairs))
    room = {f: max(0, min(map(len, fams[f])) - sum(by[p[0]]["family"] == f for p in pairs)) for f in sorted(shared)}
    whole = sum(room.values())
    quota = {f: 0 for f in shared}
    if left and whole:
        raw = {f: left * room[f] / whole for f in shared}
        quota = {f: min(room[f], math.floor(raw[f])) for f in shared}
        rest = left - sum(quota.values())
        for f in sorted(sorted(shared), key=lambda f: (-round(raw[f] - math.floor(raw[f]), 9), -room[f])):
            if rest > 0 and quota[f] < room[f]:
                quota[f] += 1
                rest -= 1

    def ordered(f):
        near = [e for e in edges[f] if e["d"] <= cal[f][1]]
        seeded = lambda e: (by[e["s"]]["sequence"], by[e["m"]]["sequence"]) in core_seeds
        return sorted(near, key=lambda e: (not seeded(e), not e["both"], e["d"] / max(cal[f][1], 1e-9), (e["a"] or 13) + (e["b"] or 13), e["tie"]))

    core_seeds = set(seeds)
    for f in sorted(shared):
        if quota[f] <= 0 or math.isnan(cal[f][1]):
            continue
        rows_, here = ordered(f), 0
        start = max(1, min(total.values(), default=1))
        for cap in np.unique(np.ceil(np.linspace(start, max(caps.values()), 12)).astype(int)):
            for e in rows_:
                if here >= quota[f] or len(pairs) >= target:
                    break
                if fits(e, False, int(cap)):
                    take(e, "EXT")
                    here += 1
    for f in sorted(shared):
        for e in ordered(f):
            if len(pairs) >= target:
                break
            if fits(e, False):
                take(e, "EXT")
    for r in ok:
        i, f = r["item"], r["family"]
        if i in used:
            continue
        mine = [e for e in edges.get(f, []) if i in (e["s"], e["m"])]
        why[i] = "family_not_shared_between_classes" if f not in shared else "no_cross_class_neighbor_in_extended_top_k" if not mine else "above_extended_family_caliper" if not any(e["d"] <= cal[f][1] for e in mine) else "expanded_target_reached" if len(pairs) >= target else "one_to_one_or_capacity_limit"
    return pairs, why


@pytest.fixture(scope="module")
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.mark.parametrize(("seed", "families", "subjects", "sequences"), [(1, 3, 2, 1), (2, 6, 5, 3), (3, 2, 2, 2)])
def test_whole_matching(spark, checkpoints, seed, families, subjects, sequences):
    rows = items_of(seed, 260, families, subjects, sequences)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = matching.build_matching(df, check=False)
    manifest, pairs, summary = made
    want, why = plain([r.asDict() for r in df.collect()])
    assert sorted((r.sick, r.normal, r.stage, r.pair_id) for r in pairs.collect()) == sorted(want)
    assert {r.item: r.exclusion_reason for r in manifest.collect()} == why
    told = {r.item: (r.selected, r.core, r.partner) for r in manifest.collect()}
    for s, m, stage, _ in want:
        assert told[s] == (1, int(stage == "CORE"), m) and told[m] == (1, int(stage == "CORE"), s)
    assert {(r.family, r.stage): r.pairs for r in summary.collect()}[None, None] == len(want)
    assert any(stage == "EXT" for _, _, stage, _ in want) and any(stage == "CORE" for _, _, stage, _ in want)
    by = {r.item: r for r in df.collect()}
    open_ = [i for i, reason in why.items() if reason in ("", "one_to_one_or_capacity_limit", "expanded_target_reached", "above_extended_family_caliper", "no_cross_class_neighbor_in_extended_top_k", "family_not_shared_between_classes")]
    for r in made.families.collect():
        own = [by[i] for i in open_ if by[i].family == r.family]
        assert (r.items_0, r.items_1) == tuple(sum(x.label == c for x in own) for c in (0, 1))
        assert (r.subjects_0, r.subjects_1) == tuple(len({x.subject for x in own if x.label == c}) for c in (0, 1))
        counts = [sum(stage == kind and by[s].family == r.family for s, _, stage, _ in want) for kind in ("CORE", "EXT")]
        assert [r.core_pairs, r.added_pairs] == counts and r.pairs == sum(counts) and r.core_edges <= r.edges and r.core_caliper <= r.extended_caliper
    t = made.totals.first()
    assert (t.items, t.eligible, t.pairs, t.selected_0, t.selected_1) == (len(by), len(open_), len(want), len(want), len(want))
    assert t.core_pairs == sum(stage == "CORE" for _, _, stage, _ in want) and t.share_of_items == 2 * len(want) / len(by) and t.target_achieved == (len(want) >= t.target)


def test_invariants(spark):
    rows = [(1, "a", 0, 1), (2, "b", 0, 1), (3, "c", 1, 1), (4, "d", 1, 0)]
    df = spark.createDataFrame(rows, "item long, subject string, label int, selected int")
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="unequal"):
        matching.check_matching(df, F.col("label"), "subject")
    with pytest.raises(ValueError, match="few subjects"):
        matching.check_matching(df.where("item in (1, 3)"), F.col("label"), "subject")


def test_allocation(spark):
    for capacities, target, want in (({1: 3, 2: 3, 3: 4}, 5, {1: 2, 2: 1, 3: 2}), ({1: 2, 2: 5}, 7, {1: 2, 2: 5}), ({1: 0, 2: 4}, 3, {1: 0, 2: 3}), ({1: 2, 2: 2}, 9, {1: 2, 2: 2})):
        df = spark.createDataFrame([*capacities.items()], "family long, capacity long")
        assert {r.family: r.quota for r in matching.allocate(df, target).collect()} == want


def test_blocks_of_neighbours(spark, monkeypatch):
    """The same edges whatever the size of blocks."""
    rng = np.random.default_rng(5)
    rows = [(k, k % 2, int(rng.integers(0, 2)), rng.integers(0, 3, 4).astype(float).tolist()) for k in range(120)]
    df = spark.createDataFrame(rows, "item long, family long, label int, v array<double>")
    edges = lambda: sorted(map(tuple, neighbours.mutual_edges(df, "family", "item", "label", "v", 4, 2).collect()), key=str)
    one = edges()
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    assert edges() == one and one


def test_families_take_the_best_of_several_starts(spark, checkpoints):
    rng = np.random.default_rng(2)
    rows = [(k, (np.eye(9)[k % 9] * 30 + rng.normal(size=9)).tolist()) for k in range(180)]
    df = spark.createDataFrame(rows, "item long, v array<double>")
    got = {r.item: r.family for r in matching.families(df, "v").collect()}
    assert len(set(got.values())) == matching.family_count(180) == 8
    assert sum(len({got[k] for k in range(c, 180, 9)}) == 1 for c in range(9)) >= 7  # eight families for nine groups: hardly one is cut
