from hypothesis import given
from hypothesis import strategies as st

from kittiwake.llm.gazetteer import Dictionary, deletes, map_to_list, weighted_distance

CITIES = [(1, "Gerdrioth", None, "KD"), (2, "Great Stongan", None, "RA"), (3, "Reirhel Springs", "Triomquarn", "VZ"), (4, "New Lushembio", None, "TA"), (5, "North Liskbaebon", None, "VX"), (6, None, None, None), (7, "Ab", None, "")]
REF = "city_id long, city_name string, alt_name string, admin_code string, value string"
small = st.text("abc", max_size=6)


def plain(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@given(small, small)
def test_deletion_sets_meet_within_the_bound(a, b):
    d = plain(a, b)
    for n in (1, 2):
        if d <= n:
            assert deletes(a, n) & deletes(b, n)
    assert 0.65 * d <= weighted_distance(a, b, 99) <= d
    assert (weighted_distance(a, b, 99) == 0) == (a == b)


def test_variants():
    d = Dictionary.of(CITIES, {1: 50})
    meant = {
        "gerdrioth": 1, "GERDRIOTH (KD)": 1, "Gedrioth": 1, "Gerdrioht, 10062": 1, "near Gerdrioth": 1, " city of  Gerdrioth.": 1, "Gerdrioth, downtown": 1, "Gt. Stongan": 2,
        "GtSttongan": 2, "Reirhel.Spgs / VZ": 3, "triomquarn": 3, "N. lushembio": 4, "N liskbaebon": 5, "11052 great-stongan": 2,
    }
    assert {v: (d.best(v) or (0,))[0] for v in meant} == meant
    for v in ("unknown", "n/a", "--", "Ganekheir", "Great Other", "", "12345", "KD", "zz"):
        assert d.best(v) is None, v


@given(st.text("abcd", min_size=36, max_size=70), st.lists(st.tuples(st.sampled_from("diws"), st.integers(0, 99), st.sampled_from("abcd")), max_size=2))
def test_long_names_are_met_by_their_parts(name, edits):
    typed = list(name)
    for kind, at, letter in edits:
        k = at % (len(typed) - 1)
        typed[k : k + (2 if kind == "s" else 0 if kind == "i" else 1)] = {"d": [], "i": [letter], "w": [letter], "s": typed[k : k + 2][::-1]}[kind]
    d = Dictionary.of([(1, name, None, None)], {})
    hit = d.best("".join(typed))
    assert hit and hit[0] == 1 and hit[1] <= len(edits)
    assert len(d.variants) + len(d.pieces) < 2000


def test_lists_of_the_caller():
    d = Dictionary.of([(1, "Bad Homburg", None, None)], {}, affixes={"bad": ("b",)}, noise=("kreis",))
    assert d.best("B. Homburg, Kreis") == (1, 0.0) and d.best("city of Bad Homburg") is None


def test_operator(spark):
    typed = ["Gerdrioth", "gerdrioth", "Gedrioth", "nowhere at all", "  ", "", None, "　", "x" * 100000, "Gedrioth"]
    rows = spark.createDataFrame([(k, v, 1) for k, v in enumerate(typed)] + [(None, "Gerdrioth", 1)], "id long, city string, entry int")
    ref = spark.createDataFrame([(*c, "clash") for c in CITIES], REF)
    got = {r.key: (r.entry, r.distance) for r in map_to_list(rows, ref).collect()}
    assert got == {0: (1, 0.0), 1: (1, 0.0), 2: (1, 1.0), 3: (None, None), 8: (None, None), 9: (1, 1.0)}
    blocks = {r.key: (r.entry, r.distance) for r in map_to_list(rows, ref, block=2).collect()}
    assert blocks == got
    assert sorted(r.key for r in map_to_list(rows, ref, exact_too=False).collect()) == [1, 2, 3, 8, 9]
    assert all(r.entry is None for r in map_to_list(rows, ref.limit(0)).collect())
    assert map_to_list(rows.limit(0), ref).count() == 0


def test_ties_go_to_the_more_frequent(spark):
    ref = spark.createDataFrame([(1, "Mabbet", None, None, ""), (2, "Mappet", None, None, "")], REF)
    rows = spark.createDataFrame([(1, "Mappet"), (2, "Mappet"), (3, "Mabbet"), (4, "Mabpet")], "id long, city string")
    assert {r.key: r.entry for r in map_to_list(rows, ref).collect()}[4] == 2


def test_blocks_give_the_rows_of_one_block(spark):
    ref = spark.createDataFrame([(1, "Mabbet", None, "KD", ""), (2, "Mappet", None, "VZ", ""), (3, "Sorn", None, "KD", ""), (4, "Sorn Town", None, "RA", "")], REF)
    rows = spark.createDataFrame([(1, "Mappet"), (2, "Mappet"), (3, "Mabbet"), (4, "Mabpet"), (4, "Mabpet"), (5, "Mappet RA"), (6, "sorn town"), (7, "Sorn"), (8, "Sorn"), (9, "xxyyzz"), (9, "xxyyzz")], "id long, city string")
    one = sorted(((r.key, r.value, r.entry, r.distance) for r in map_to_list(rows, ref).collect()), key=str)
    assert len(one) == 11 and {k: e for k, _, e, _ in one}.items() >= {4: 2, 5: 2, 6: 4, 9: None}.items()
    assert sorted(((r.key, r.value, r.entry, r.distance) for r in map_to_list(rows, ref, block_bytes=1000).collect()), key=str) == one
    for block in (1, 2, 3, 4):
        assert sorted(((r.key, r.value, r.entry, r.distance) for r in map_to_list(rows, ref, block=block).collect()), key=str) == one, block
