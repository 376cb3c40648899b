"""The step each method is named for decides: leaving it out gives other rows."""

from attesta.llm import cutoffs, entities, mixing, names, skeletons, survivors
from pyspark.sql import functions as F


def test_counts_of_last_words_decide_marked_and_unmarked_endings(spark):
    names = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]
    rows = [f"In {n} we saw this. The {n} fell again." for n in names] + [f"Of {n} we know little. Signed by the board" for n in names[:40]]
    df = spark.createDataFrame([("t", i, "s", x) for i, x in enumerate([*rows, "In zz we saw this.", "In zz we"])], "part string, rid bigint, source string, body string")
    got = {r.rid: r.cut for r in cutoffs.verdicts(df).collect()}
    # a sentence mark after which texts always go on is no end, a word without a mark that always ends texts is one
    assert got[len(rows)] and got[len(rows) + 1] and not any(got[i] for i in range(len(rows)))


def test_dependencies_between_bundles_decide(spark):
    one = [(i, "g", "Letters in Polar Logistics Research", "Alpha plots.", ["Ann Lee"]) for i in range(1, 4)]
    two = [(i, "g", "Annals of Moss", "Beta plots were measured for a much longer time.", ["Bo Ray", "Cy Fox"]) for i in range(4, 7)]
    df = spark.createDataFrame([(*r, "2024-01-01") for r in one + two], "cand_id bigint, canonical_id string, venue string, content string, authors array<string>, at string").withColumn("at", F.col("at").cast("timestamp"))
    bundles = (survivors.venue(), survivors.content(), survivors.authors())
    pick = lambda **k: tuple(survivors.survivors(df, "canonical_id", "cand_id", "at", bundles, **k).first())[1:]
    assert pick(agreeing=False) == (3, 6, 6) and pick() == (6, 6, 6)


def test_a_group_of_very_many_signatures_is_searched_within_its_bound(spark):
    df = spark.range(5000).select(F.col("id").alias("cand_id"), F.lit("g").alias("canonical_id"), F.concat(F.lit("V"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("venue"), F.concat(F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" text.")).alias("content"), F.array(F.lit("Ann Lee")).alias("authors"), F.current_timestamp().alias("at"))
    got = survivors.survivors(df, "canonical_id", "cand_id", "at", (survivors.venue(), survivors.content(), survivors.authors())).collect()
    assert len(got) == 1 and got[0].authors_id == 4999 and got[0].venue_id is not None


def test_a_signature_of_a_small_share_that_alone_agrees_is_chosen(spark):
    word = lambda n: "".join("abcdefghij"[int(x)] for x in f"{n:04d}")
    rows = [(2 * n + k, "g", "Letters in Moss", f"{word(n)} plots were measured here.", [f"Ann {word(n)}"]) for n in range(100) for k in (0, 1)]
    # the longest text was seen with others only, and the texts of the others are shares of 1/100
    rows += [(1000 + k, "g", "Annals of Kiln Physics", "Zeta plots were measured for a longer time.", ["A. Z."]) for k in (0, 1)] + [(2000, "g", "Letters in Moss", None, ["Bo Fox", "Cy Lee"])]
    df = spark.createDataFrame([(*r, "2024-01-01") for r in rows], "cand_id bigint, canonical_id string, venue string, content string, authors array<string>, at string").withColumn("at", F.col("at").cast("timestamp"))
    bundles = (survivors.venue(), survivors.content(), survivors.authors())
    got = survivors.survivors(df, "canonical_id", "cand_id", "at", bundles).first()
    assert (got.venue_id, got.content_id) == (2000, 199)


def test_the_search_among_partners_finds_the_most_trust():
    import itertools
    import random
    rnd = random.Random(3)
    for _ in range(80):
        sets = [sorted(((rnd.choice([-0.5, 1.0, 1.25, 1.5, 2.0]), f"{k}{n}", [j != k and rnd.random() < 0.7 for j in range(3)]) for n in range(rnd.randint(0, 6))), key=lambda v: -v[0]) for k in range(3)]
        seen = [(i, a, j, b) for i, j in ((0, 1), (0, 2), (1, 2)) for _, a, _ in sets[i] for _, b, _ in sets[j] if rnd.random() < 0.4]
        able = lambda i, x, j, y: not x[2][j] or not y[2][i] or (i, x[1], j, y[1]) in seen
        worth = lambda c: sum(x[0] for x in c if x)
        combos = [c for c in itertools.product(*[[None, *s] for s in sets]) if all(not c[i] or not c[j] or able(i, c[i], j, c[j]) for i, j in ((0, 1), (0, 2), (1, 2)))]
        got = tuple(None if p is None else sets[k][p] for k, p in enumerate(survivors._search(sets, seen)))
        assert got in combos and abs(worth(got) - max(map(worth, combos))) < 1e-9


def test_linkage_decides_between_entities_a_spelling_can_mean(spark, monkeypatch):
    ref = spark.createDataFrame([("author", 1, "Anna B. Torvald"), ("author", 2, "Anton Torvald")], "kind string, entity_id bigint, name string")
    said = ["Anna B Torvald", "Torvald, Anna B.", "TORVALD Anna B.", "Anna B. Torvald", "Anna Torvald", "Anton Torvald", "A. Torvald"]
    df = spark.createDataFrame([("author", s) for s in said], "kind string, spelling string")
    got = {r.spelling: r.entity_id for r in names.link_spellings(df, ref).collect()}
    assert all(got[s] == 1 for s in said[:5]) and got["Anton Torvald"] == 2 and got["A. Torvald"] in (1, 2)
    monkeypatch.setattr(names, "LINKAGE", 1.1)
    assert names.link_spellings(df, ref).count() == 0


def test_only_surnames_with_like_letters_are_compared_edit_by_edit(monkeypatch):
    import random
    rnd, calls, whole = random.Random(4), [], names.distance
    letters = "abcdeilnorst"
    sur = ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 11))).capitalize() for _ in range(60)]
    persons = [names.person(f"{g} {m}{s}") for s in sur for g, m in (("Anna", "B. "), ("Robert", ""), ("Kai", "van "))]
    said = []
    for s in sur:
        i = rnd.randrange(len(s) - 1)
        said += [f"A. {s[:i] + rnd.choice(letters) + s[i:]}", f"{s[:i] + s[i + 1] + s[i] + s[i + 2:]}, Bob", f"van {s[:i] + s[i + 1:]} Kai", f"{s[:1] + s[2:-1]}o, Anna"]

    def plain(x, p):
        able = [(whole(a, p.surname, 2), rest) for a, rest in names._orders(names.said(x), p.surname.count(" ") + 1)]
        near = [(d, rest) for d, rest in able if d < 2 or (d == 2 and len(p.surname) >= 9 and any(a[:3] == p.surname[:3] and whole(a, p.surname, 2) == 2 and r == rest for a, r in names._orders(names.said(x), p.surname.count(" ") + 1)))]
        return min((c for d, rest in near if (c := names._rest_cost(rest, p, d)) is not None), default=None)

    want = [[plain(x, p) for p in persons] for x in said]
    monkeypatch.setattr(names, "distance", lambda *a: calls.append(a) or whole(*a))
    assert [names.person_costs(x, persons) for x in said] == want and sum(c is not None for w in want for c in w) > 100
    compared = sum(a[1] in {p.surname for p in persons} for a in calls)
    assert compared < 0.2 * len(said) * len(persons) / 3


def test_transitivity_lowers_the_weaker_of_two_matches(spark):
    cell = (0, 10, 0, 0)
    rows = [(0, 1, 11, *cell, 0.99), (0, 1, 12, *cell, 0.97), (1, 11, 12, *cell, 0.02), (0, 2, 11, *cell, 0.9), (0, 2, 13, *cell, 0.8), (1, 11, 13, *cell, 0.95), (0, 3, 14, *cell, 0.96), (0, 3, 15, *cell, 0.96)]
    at = spark.createDataFrame(rows, "kind int, p1 bigint, p2 bigint, u int, g int, y int, d int, q double")
    got = {(r.p1, r.p2): r.q for r in entities._transitive(at).collect()}
    assert got[1, 11] == 0.99 and got[1, 12] < 0.05 and got[2, 11] == 0.9 and got[2, 13] == 0.8
    assert got[3, 14] == 0.96 and got[3, 15] == 0.0  # they never met


def test_titles_without_a_rare_word_in_common_meet_without_persons(spark):
    people = [f"Ann Sur{x}{y}" for x in ("kamero", "tezuvo", "lanepi", "sukaro") for y in ("berg", "sted", "mann")]
    one = [(i, f"throughput and dropout in fleets: a study of {100 + i} plots", [people[i % 12], people[i % 7]], 1980 + i % 40, None) for i in range(120)]
    name = lambda i: "".join("bdfgklmnprstvz"[(i * k + k) % 14] + "aeiou"[(i + k) % 5] for k in (1, 3, 5, 9)) + "x"
    one += [(200 + i, f"the limits of {name(i)} for early dropout", [people[i % 11]], 1980 + i % 37, None) for i in range(40)]
    two = [(1000 + i, t.upper(), who, y, d) for i, t, who, y, d in one]
    one += [(500, "throughput and dropout in fleets: a study of 999 plots", None, 2001, None), (501, "the limits of lovuzebil for early dropout", None, 2002, None), (502, "throughput and dropout in fleets: a study of 998 plots", None, None, None)]
    two += [(1500, one[-3][1], ["Zed Quorlander"], 2001, "10.1/zz"), (1501, "the limits of lovuezbil for early dropout", ["Bo Harwimere"], 2002, None), (1502, "throughput and dropuot in fleets: a study of 998 plots", ["Cy Harwimere"], None, None)]
    cols = "title string, authors array<string>, year int, doi string"
    got = {(r.rec_id, r.work_id) for r in entities.matches(spark.createDataFrame(one, "rec_id bigint, " + cols), "rec_id", spark.createDataFrame(two, "work_id bigint, " + cols), "work_id").collect()}
    assert {(500, 1500), (501, 1501), (502, 1502)} <= got and len({(i, 1000 + i) for i in range(120)} - got) == 0
    assert all(w == r + 1000 for r, w in got)


def test_works_that_match_one_record_are_compared_whether_they_met_or_not(spark):
    rows = [(1, 11, "a drift monitor for alpine soils", "a drift monitor for alpine soils"), (1, 12, "a drift monitor for alpine soils", "drift monitor for the alpine soils")]
    p = spark.createDataFrame([(0, 1, rows[0][2], "Ann Lee", 2001, ""), (1, 11, rows[0][3], "Ann Lee", 2001, ""), (1, 12, rows[1][3], "", 2001, "")], "side int, pid bigint, title string, authors string, year int, doi string")
    ab = spark.createDataFrame([(1, 11, 0, 10, 0, -1, 0.9), (1, 12, 0, -1, 0, -1, 0.8)], "p1 bigint, p2 bigint, u int, g int, y int, d int, q double")
    works = entities._works_compared(p, entities._twos(ab), None, [])
    assert [tuple(r) for r in works.collect()] == [(11, 12, 0, -1, 0, -1)]
    assert entities._works_compared(p, entities._twos(ab), works, []).count() == 1


def test_words_are_compared_edit_by_edit_once_and_only_with_like_letters(monkeypatch):
    calls, whole = [], entities.distance
    monkeypatch.setattr(entities, "distance", lambda *a: calls.append(a) or whole(*a))
    assert entities.unmatched("the limits of lovuzebil for early dropout", "the limits of kesulipil for early dropout") == 2 and len(calls) == 1
    calls.clear()
    assert entities.authors_agree("Ann Kamerostad;Bo Tezuvoberg", "Cy Koplinusgrum;Di Tibaliwend") == 0 and not calls
    assert entities.authors_agree("Ann Kamerostad;Bo Tezuvoberg", "A. Kamerostda;Tezuvobreg, B.") == 1 and len(calls) == 2


def test_the_mixture_uses_whether_the_rest_makes_up_for_the_titles():
    cells = entities.np.array([[0, 10, 0, 0], [1, 10, 0, 2], [1, 10, 0, 0], [-1, 10, 0, 0], [-1, 10, 0, -1]])
    assert entities.made_up_for(cells).tolist() == [True, False, True, True, False]
    assert entities._values(cells).shape == (5, 5)


def test_shares_of_a_mix_are_reached_in_whole_blocks(spark):
    sizes = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else "a", 20 + i % 90) for i in range(6000)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.report(mixing.mix(sizes, targets), targets).collect()}
    assert all(abs(got[s].actual_share - want) < 0.005 for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2))) and got["b"].most_copies <= 2


def test_prototypes_are_closed_and_keep_what_looks_different():
    for cp in [*range(0x370, 0x590), *range(0x13A0, 0x1400), *range(0x2100, 0x2190), *range(0x1D400, 0x1D800), *range(0xFF00, 0xFFEF)]:
        once = skeletons.skeleton(chr(cp))
        assert skeletons.skeleton(once) == once
    same = lambda a, b: skeletons.skeleton(a) == skeletons.skeleton(b)
    assert same("\U0001d400\U0001d41b", "Ab") and same("Ⅳ", "IV") and same("օո", "on") and same("Ꭺ", "A")
    assert not same("m²", "m2") and not same("①", "1") and not same("½", "1/2") and not same("α", "a") and not same("ı", "i")
