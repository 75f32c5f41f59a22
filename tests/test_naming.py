"""Names by strategy against taking turns in plain Python."""

import random

import pytest

from tonearm.operators import naming as N

KIND = {x: k for k, xs in N.KINDS.items() for x in xs}
SCHEMA = "path string, parent string, depth int, role string, tempo string, band string, style string, traits array<string>, differentiators array<string>"


def kind(x):
    return "energy" if "energy" in x.lower() else KIND.get(x.lower(), x.lower())


def two(labels):
    out = []
    for x in labels:
        if len(out) < 2 and all(kind(x) != kind(y) for y in out):
            out.append(x)
    return " + ".join(out) or None


def plain_options(c, strategy):
    traits, told = ([x for x in c[k] or () if x] for k in ("traits", "differentiators"))
    known = {k: c[k] or None for k in ("role", "tempo", "band", "style")}
    known |= {"traits": " + ".join(traits[:2]) or None, "relative": two(told), "distinctive": two(told + traits), "range": known["tempo"] and known["tempo"].removesuffix(" BPM")}
    one = known["traits"]
    if told:
        known["utility"] = two(told + traits)
    elif len(traits) == 1 and known["band"]:
        known["utility"] = f"{known['band']} + {one}"
    else:
        known["utility"] = one or known["band"] or known["tempo"]
    out = []
    for pattern in N.PATTERNS[strategy][c["depth"] > 0]:
        if all(v or "{" + k + "}" not in pattern for k, v in known.items()):
            name = " ".join(pattern.format(**known).strip(" -").split())
            if name.lower() not in [x.lower() for x in out]:
                out.append(name)
    return out


def plain_names(clusters, strategy):
    used, names = set(), {}
    for c in sorted(clusters, key=lambda c: (c["depth"], c["path"])):
        options = plain_options(c, strategy)
        above = names.get(c["parent"])
        tries = options + ([f"{x} / {above}" for x in options] if above else [])
        name = next((x for x in tries if x.lower() not in used), None)
        k = 2
        while name is None:
            name = None if f"{options[0]} {k}".lower() in used else f"{options[0]} {k}"
            k += 1
        used.add(name.lower())
        names[c["path"]] = name
    return names


def cluster(rng, path, parent, depth):
    pick = lambda *xs: rng.choice([*xs, None])
    labels = ["Warm", "Bright", "Sparse", "Open", "Punchy", "Smooth", "Low Energy", "Highest Energy", "Fastest", "Slowest", ""]
    some = lambda: rng.choice([None, rng.sample(labels, rng.randrange(0, 4))])
    return {"path": path, "parent": parent, "depth": depth, "role": pick("Peak", "Tools", ""), "tempo": pick("120 BPM", "118-124 BPM"), "band": pick("Low Energy", "High Energy"), "style": pick("House", "house", " - Deep  House "), "traits": some(), "differentiators": some()}


@pytest.mark.parametrize("strategy", sorted(N.PATTERNS))
def test_names_are_those_of_taking_turns(spark, strategy):
    rng = random.Random(strategy)
    tree = [cluster(rng, f"r{i:02d}", None, 0) for i in range(5)]
    tree += [cluster(rng, f"{p['path']}-{k}", p["path"], 1) for p in list(tree) for k in range(1 + (p["path"] > "r02"))]
    bare = {"role": None, "tempo": None, "band": None, "style": None, "traits": None, "differentiators": []}
    tree += [{"path": f"z{i}", "parent": None, "depth": 0} | bare for i in range(3)] + [{"path": f"z0-{i}", "parent": "z0", "depth": 1} | bare for i in range(3)]
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    got = {r.path: r.name for r in N.strategy_names(spark.createDataFrame([tuple(c[k] for k in columns) for c in tree], SCHEMA), strategy).collect()}
    want = plain_names(tree, strategy)
    assert got == want and len({x.lower() for x in want.values()}) == len(tree)


def test_labels_of_one_kind_count_once(spark):
    row = spark.createDataFrame([(["Warmest", "Bright", "Most Open", "Dense"],)], "x array<string>")
    assert row.select(N.two_kinds(row.x)).first()[0] == "Warmest + Most Open"


def test_empty_tree(spark):
    assert N.strategy_names(spark.createDataFrame([], SCHEMA)).count() == 0
