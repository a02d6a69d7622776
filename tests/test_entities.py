"""Entity resolution: configuration, scores, validation, and the whole of it against a plain version in memory."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sievelight.operators import entities, resolve
from sievelight.operators.entities import BlockRule, DedupConfig, ExactRule, MatchRule, Validation


def _clusters(found):
    own = defaultdict(list)
    for r in found.members.collect():
        own[r["cluster"]].append(r["id"])
    return {r["cluster"]: (sorted(own[r["cluster"]]), r["cohesion"]) for r in found.clusters.collect()}


def _frame(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {schema}")


def test_config():
    config = DedupConfig.from_dict({
        "threshold": 0.82, "rules": [{"columns": ["first", "last"], "method": "composite_exact", "weight": 2}], "blocking_rules": [{"column": "first", "method": "ngram", "length": 3}],
        "exact_match_rules": [{"columns": ["customer"], "normalizers": ["identifier"]}],
    })
    assert config.version == 2 and config.cluster_validation.method == "representative" and config.rules[0].columns == ("first", "last")
    for bad in (
        {"rules": [{"column": "name", "method": "unknown"}]}, {"rules": [{"column": "name", "method": "composite_exact"}]}, {"rules": [{"method": "exact"}]}, {"rules": [{"column": "name", "weight": 9}]},
        {"blocking_rules": [{"column": "name", "method": "ngram", "normalizers": ["unknown"]}]}, {"exact_match_rules": [{"columns": ["id"], "normalizers": ["unknown"]}]},
        {"threshold": 0}, {"prior_probability": 0.9}, {"cluster_validation": {"method": "x"}}, {"blocking_rules": [{"column": "a", "length": 0}]}, {"rules": [{"column": "a", "m_probability": 0.4}]},
    ):
        with pytest.raises(ValueError):
            DedupConfig.from_dict(bad)
    with pytest.raises(ValueError):
        config.check_columns(["first", "last"])
    config.check_columns(["first", "last", "customer"])


def test_derived_blocks_find_typos(spark):
    df = _frame(spark, [("Siti Nuraini",), ("Sitti Nuraini",), ("Andi Wijaya",)], "name string")
    rules = entities.derived_blocking((MatchRule(("name",), "jaro_winkler", normalizers=("name",)),))
    found = {(r["a"], r["b"]) for r in resolve.pairs_within(df, "id", entities.block_rules(df, rules)).collect()}
    assert (0, 1) in found and (0, 2) not in found
    assert found == {(r["a"], r["b"]) for r in resolve.pairs_within(df, "id", entities.block_rules(df, rules), None).collect()}


def test_pair_totals(spark):
    """Totals of pairs in blocks of any size: equal rows, rows that share one or several of their blocks, rows without any, against pairs in memory."""
    rng = random.Random(7)
    rows = [(rng.choice("abc") if rng.random() < 0.7 else "", rng.choice(["p q", "q r", "r", ""])) for _ in range(150)]
    df = _frame(spark, rows, "x string, y string")
    rules = [("x", resolve.block_keys("exact", [F.col("x")])), ("y", F.filter(F.split("y", " "), lambda w: w != ""))]
    of = {i: {("x", x)} - {("x", "")} | {("y", w) for w in y.split()} for i, (x, y) in enumerate(rows)}
    want = sorted((a, b) for a, b in combinations(sorted(of), 2) if of[a] & of[b])
    assert want == sorted((r["a"], r["b"]) for r in resolve.pairs_within(df, "id", rules, None).collect())
    assert tuple(resolve.pair_totals(df, "id", rules).first()) == (len(want), sum(a for a, _ in want), sum(b for _, b in want))
    for few in (df.limit(0), df.filter("id = 3")):
        assert tuple(resolve.pair_totals(few, "id", rules).first()) == (0, None, None)


def test_totals_of_a_large_block(spark):
    """500,000 rows of one block: its 125 billion pairs are counted, not built."""
    n = 500_000
    found = resolve.pair_totals(spark.range(n), "id", [("k", F.array(F.lit("same")))])
    assert tuple(found.first()) == (n * (n - 1) // 2, sum(i * (n - 1 - i) for i in range(n)), sum(i * i for i in range(n)))


def _scores(spark, df, rules, pairs, prior=0.05):
    rows = entities.evidence(df, "id", rules, True)
    table = spark.createDataFrame(pairs, "a long, b long")
    return {(r["a"], r["b"]): (r["score"], dict(r["parts"])) for r in entities.scored(table, rows, rules, prior).collect()}


def test_required_evidence_vetoes(spark):
    df = _frame(spark, [("Budi Santoso", "1990-01-01", "001"), ("Budi Santos", "1990-01-01", "999"), ("Other", "1980-01-01", "777")], "name string, birth_date string, nik string")
    base = (MatchRule(("name",), "jaro_winkler", normalizers=("name",)), MatchRule(("birth_date",), normalizers=("date",)))
    assert _scores(spark, df, base, [(0, 1)])[0, 1][0] > 0.8
    score, parts = _scores(spark, df, (*base, MatchRule(("nik",), normalizers=("identifier",), required=True)), [(0, 1)])[0, 1]
    assert score == 0 and parts["nik"] == 0


def test_rare_values_that_are_near_say_little(spark):
    df = _frame(spark, [(f"Customer {i:05d}", f"user{i:05d}@example.com") for i in range(100)], "name string, email string")
    rules = (MatchRule(("name",), "jaro_winkler"), MatchRule(("email",), "email"))
    assert _scores(spark, df, rules, [(1, 2)])[1, 2][0] < 0.8


def test_columns_and_rows_score_alike(spark):
    """The Column form and the form for single pairs agree for every method, with gaps, penalties, vetoes and repeated columns."""
    rng = random.Random(2)
    names = ["Budi Santoso", "Budi  Santosa", "santoso budi", "Siti", None, "", "aeiou", "Dr. Siti Nuraini"]
    rows = [(rng.choice(names), rng.choice(["0812-345678", "62812345678", None, "0899"]), rng.choice(["a@gmial.com", "a@gmail.com", "b@x.id", None]), rng.choice(["x", "y", None])) for _ in range(40)]
    df = _frame(spark, rows, "name string, phone string, email string, city string")
    rules = tuple(MatchRule((c,), m, weight=w, mismatch_penalty=p, required=q) for c, m, w, p, q in (
        ("name", "jaro_winkler", 1.0, 0.0, False), ("name", "token_sort", 0.5, 0.0, False), ("name", "token_set", 0.5, 0.3, False), ("name", "fuzzy_ratio", 0.5, 0.0, False), ("name", "phonetic", 0.5, 0.0, False),
        ("phone", "phone", 2.0, 0.0, False), ("email", "email", 2.0, 0.5, False), ("city", "exact", 1.0, 1.0, True),
    )) + (MatchRule(("name", "city"), "composite_exact"),)
    pairs = list(combinations(range(40), 2))
    for own, prior in ((rules, 0.05), (entities.role_rules({"phone": "phone", "email": "email", "name": "name"}), None)):
        got = entities.scored(spark.createDataFrame(pairs, "a long, b long"), entities.evidence(df, "id", own, prior is not None), own, prior).collect()
        of = {r["id"]: r["e"] for r in entities.evidence(df, "id", own, prior is not None).collect()}
        one = entities.Scorer(own, prior)
        assert len(got) == len(pairs)
        for r in got:
            score, parts = one(of[r["a"]], of[r["b"]])
            assert r["score"] == pytest.approx(score, abs=1e-9) and dict(r["parts"]) == pytest.approx(parts, abs=1e-4)
    assert {"name", "name#2", "name+city"} <= set(entities.part_keys(rules))


def test_whole_rows(spark):
    rows = _frame(spark, [("Rina", "0812"), ("Rina", "0812"), ("Rina", "0899")], "name string, phone string")
    assert list(_clusters(entities.resolve_entities(rows, "id", DedupConfig(exact_row_match=True))).values()) == [([0, 1], 1.0)]
    odd = _frame(spark, [("same", 10, None)] * 3, "field_a string, field_b long, optional string")
    config = DedupConfig(cluster_validation=Validation(min_cohesion=0.9, min_representative_score=0.9))
    assert list(_clusters(entities.resolve_entities(odd, "id", config)).values()) == [([0, 1, 2], 1.0)]
    assert _clusters(entities.resolve_entities(odd.limit(0), "id", config)) == {}
    assert _clusters(entities.resolve_entities(odd, "id", DedupConfig(exact_row_match=False))) == {}


def test_large_groups_of_equal_rows(spark):
    """Groups over the block limit are passed over, and named; without a limit they are found, in clusters of bounded size (of 61 rows one is left)."""
    df = _frame(spark, [("x", "y")] * 61 + [("p", "q")] * 3, "a string, b string")
    assert [m for m, _ in _clusters(entities.resolve_entities(df, "id", DedupConfig())).values()] == [[61, 62, 63]]
    whole = _clusters(entities.resolve_entities(df, "id", DedupConfig(), most=None))
    assert sorted(len(m) for m, _ in whole.values())[-1] == 20 and sum(len(m) for m, _ in whole.values()) == 63
    keys = entities.exact_keys(df, None, ["a", "b"])
    assert [r["size"] for r in resolve.left_out(df, "id", keys).collect()] == [61]


def test_equal_rows_without_pairs(spark, monkeypatch):
    """Rows that one key alone makes the same: the clusters and pairs of the whole way, with neither pairs nor components built."""
    sizes = (1, 2, 3, 19, 20, 21, 59, 60, 61, 80, 81, 101)
    rows = [(f"v{k}", None) for k, n in enumerate(sizes) for _ in range(n)] + [(None, " ")] * 5
    random.Random(3).shuffle(rows)
    df = _frame(spark, rows, "a string, b string")

    def got(config, most):
        found = entities.resolve_entities(df, "id", config, most=most)
        assert sorted((r["cluster"], r["members"]) for r in found.groups.collect()) == sorted((k, m) for k, (m, _) in _clusters(found).items())
        return _clusters(found), sorted((r["cluster"], r["a"], r["b"], r["score"], tuple(r["parts"].items())) for r in found.pairs.collect())

    # an identity rule that says the same makes it go the whole way
    cases = [(most, DedupConfig(cluster_validation=v), DedupConfig(exact_match_rules=(ExactRule(("a",)),), cluster_validation=v)) for most, v in ((60, Validation()), (None, Validation(method="connected")))]
    want = [got(whole, most) for most, _, whole in cases]
    assert [len(m) for m, _ in want[1][0].values()].count(20) > 9
    for name in ("pairs_within", "components"):
        monkeypatch.setattr(resolve, name, lambda *a, **k: pytest.fail("built"))
    assert [got(config, most) for most, config, _ in cases] == want


def test_identity_rules_and_roles(spark):
    df = _frame(spark, [("Budi Santoso", "budi@example.com", "1-2"), ("Budi Santos", "budi@example.com", None), ("Siti Nuraini", "siti@example.com", "12"), ("Andi", None, None)], "nama string, email string, kode string")
    legacy = DedupConfig.from_dict({"threshold": 0.8, "rules": [{"column": "nama", "method": "token_sort"}, {"column": "email", "method": "email"}]})
    found = _clusters(entities.resolve_entities(df, "id", legacy))
    assert found["ec_00001"][0] == [0, 1] and found["ec_00001"][1] >= 0.8
    assert _clusters(entities.resolve_entities(df, "id"))["ec_00001"][0] == [0, 1]
    by_code = DedupConfig(exact_match_rules=(ExactRule(("kode",), ("identifier",)),), exact_row_match=False)
    assert _clusters(entities.resolve_entities(df.select("id", "kode"), "id", by_code)) == {"ec_00001": ([0, 2], 1.0)}


def test_weak_chains_are_cut(spark):
    df = _frame(spark, [("abcd",), ("abce",), ("abde",)], "name string")
    config = DedupConfig(0.7, 0.2, False, (MatchRule(("name",), "jaro_winkler", 1.0, ("name",)),), (BlockRule(("name",), "prefix", length=2),), cluster_validation=Validation(True, "representative", 0.78, 0.78))
    found = _clusters(entities.resolve_entities(df, "id", config)).values()
    assert all(c >= 0.78 and len(m) < 3 for m, c in found)
    connected = DedupConfig(0.3, 0.2, False, config.rules, config.blocking_rules, cluster_validation=Validation(method="connected"))
    assert [m for m, _ in _clusters(entities.resolve_entities(df, "id", connected)).values()] == [[0, 1, 2]]


def test_large_component(spark):
    rows = [("same entity", "group-a" if i < 60 else f"a-{i}", "group-b" if i >= 40 else f"b-{i}") for i in range(100)]
    df = _frame(spark, rows, "match_name string, block_a string, block_b string")
    config = DedupConfig(0.4, exact_row_match=False, rules=(MatchRule(("match_name",)),), blocking_rules=(BlockRule(("block_a",)), BlockRule(("block_b",))), cluster_validation=Validation(True, "representative", 0.4, 0.4))
    found = _clusters(entities.resolve_entities(df, "id", config))
    assert found and all(len(m) <= 20 and c >= 0.4 for m, c in found.values())
    assert sorted(x for m, _ in found.values() for x in m) == list(range(100))


def test_calibration(spark):
    table = lambda rows: spark.createDataFrame(rows, "score double, is_match boolean")
    none = resolve.calibrate(table([(0.9, True), (0.8, True)])).first()
    assert not none["available"] and (none["positive_pairs"], none["negative_pairs"], none["threshold"]) == (2, 0, None)
    got = resolve.calibrate(table([(0.95, True), (0.86, True), (0.82, True), (0.72, False), (0.55, False), (0.30, False)])).first().asDict()
    assert got == {"available": True, "positive_pairs": 3, "negative_pairs": 3, "threshold": 0.82, "sensitivity": 1.0, "specificity": 1.0, "balanced_accuracy": 1.0}


def _plain(rows, config, most=60):
    """Clusters (members, cohesion) of rows of text, worked out in memory."""
    score = entities.Scorer(config.rules, config.prior_probability)
    norm = lambda v: " ".join((v or "").lower().split())
    n = len(rows)
    columns = sorted(rows[0])
    values = [[(tuple(norm(r[c]) for c in rule.columns)) for rule in config.rules] for r in rows]
    evidence = []
    for v in values:
        own = []
        for i, one in enumerate(v):
            present = [w[i] for w in values if all(w[i])]
            own.append({"v": list(one), "k": one[0], "s": present.count(one) / len(present) if all(one) else 0.01})
        evidence.append(own)
    blocks, exact = defaultdict(set), defaultdict(set)
    for i, r in enumerate(rows):
        for rule in config.blocking_rules:
            v = norm(r[rule.columns[0]])
            if v:
                blocks[rule, v.replace(" ", "")[: rule.length]].add(i)
        whole = tuple(norm(r[c]) for c in columns)
        if any(whole):
            exact[whole].add(i)
    known, up = {}, list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for group in exact.values():
        if 2 <= len(group) <= most:
            for a, b in combinations(sorted(group), 2):
                known[a, b] = 1.0
                up[find(a)] = find(b)
    for group in blocks.values():
        if 2 <= len(group) <= most:
            for a, b in combinations(sorted(group), 2):
                if (a, b) not in known:
                    known[a, b] = score(evidence[a], evidence[b])[0]
                    if known[a, b] >= config.threshold:
                        up[find(a)] = find(b)
    of = lambda a, b: known.setdefault((min(a, b), max(a, b)), score(evidence[min(a, b)], evidence[max(a, b)])[0])
    holds = lambda g: sum(round(of(a, b), 4) for a, b in combinations(sorted(g), 2)) / (len(g) * (len(g) - 1) / 2)
    parts = defaultdict(list)
    for i in range(n):
        parts[find(i)].append(i)
    check, out = config.cluster_validation, []
    for part in parts.values():
        left = set(part)
        while len(left) > 1:
            mean = {x: sum(of(x, y) for y in left if y != x) / (len(left) - 1) for x in left}
            top = max(sorted(left), key=lambda x: mean[x])
            group = [top, *(x for x in sorted(left) if x != top and of(top, x) >= check.min_representative_score)]
            if len(group) < 2:
                left.remove(top)
            elif holds(group) >= check.min_cohesion:
                out.append((sorted(group)[:20], round(holds(sorted(group)[:20]), 4) if len(group) > 1 else 0.0))
                left -= set(group)
            else:
                left.remove(min(sorted(group), key=lambda x: mean[x]))
    return sorted(out, key=lambda c: (-c[1], c[0][0]))


def test_resolve_equals_plain_version(spark):
    rng, rows = random.Random(7), []
    for _ in range(40):
        name = " ".join(rng.choice(["budi", "siti", "andi", "rina", "dewi"]) + rng.choice(["", "ni", "to"]) for _ in range(2))
        city, mail = rng.choice(["medan", "solo", None]), f"{name[:4].strip()}{rng.randrange(9)}@x.id"
        for _ in range(rng.choice([1, 1, 2, 3, 5])):
            typed = list(name)
            if rng.random() < 0.4:
                typed[rng.randrange(len(typed))] = rng.choice("aeiou")
            rows.append({"name": "".join(typed), "city": city if rng.random() < 0.8 else None, "mail": mail if rng.random() < 0.9 else None})
    config = DedupConfig(0.6, 0.1, True, (MatchRule(("name",), "jaro_winkler", 1.0), MatchRule(("mail",), "exact", 1.0), MatchRule(("city",), "exact", 0.5, mismatch_penalty=0.2)), (BlockRule(("name",), "prefix", length=3), BlockRule(("mail",), "prefix", length=20)), cluster_validation=Validation(True, "representative", 0.6, 0.5))
    df = spark.createDataFrame([(i, r["name"], r["city"], r["mail"]) for i, r in enumerate(rows)], "id long, name string, city string, mail string").repartition(5)
    found = entities.resolve_entities(df, "id", config)
    got = _clusters(found)
    want = _plain(rows, config)
    assert len(want) > 10 and list(got) == sorted(got)
    assert [(m, pytest.approx(c, abs=2e-4)) for _, (m, c) in sorted(got.items())] == want
    pairs = {(r["cluster"], r["a"], r["b"]) for r in found.pairs.collect()}
    assert pairs == {(k, a, b) for k, (m, _) in got.items() for a, b in combinations(m, 2)}
    assert found.roles == {"name": "name", "email": "mail"}


def test_ten_thousand_rows(spark):
    """Ten thousand rows with a thousand copies: each is found, and nothing else."""
    rng = random.Random(3)
    rows = [(i, f"{rng.choice('BCDFGHJK')}{i:05d} {rng.choice(['Santoso', 'Wijaya', 'Lestari'])}", f"user{i}@mail{i % 40}.id", f"0812{i:08d}") for i in range(9000)]
    rows += [(9000 + k, rows[k * 9][1].replace("a", "e", 1), rows[k * 9][2], rows[k * 9][3]) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, name string, email string, phone string").repartition(8)
    found = entities.resolve_entities(df, "id", DedupConfig(rules=(MatchRule(("name",), "jaro_winkler", normalizers=("name",)), MatchRule(("email",), "email"), MatchRule(("phone",), "phone"))))
    got = sorted(m for m, _ in _clusters(found).values())
    assert got == [[k * 9, 9000 + k] for k in range(1000)]
    assert found.clusters.filter(F.col("status") != "pending").isEmpty()
