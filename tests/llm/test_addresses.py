from itertools import combinations

from kittiwake.llm.addresses import link_addresses, link_streets, parse_street, parse_zip, same_building

USER = "id long, street string, city string, zipcode string, n int, root string, told string"
REF = "city_id long, city_name string, alt_name string, admin_code string"


def test_parse():
    assert parse_street("No. 21, nalttis str.") == ("21", "nalttis", "street", None, None)
    assert parse_street("Unit 5, Sokdae road 9") == ("9", "sokdae", "road", "5", None)
    assert parse_street("c/o front desk, Apt 3, 21 Jostrul Road") == ("21", "jostrul", "road", "3", None)
    assert parse_street("22 zOndThar SqUAre, Brethkei") == ("22", "zondthar", "square", None, "brethkei")
    assert parse_street("26 Krumu St #B.") == ("26", "krumu", "street", "b", None)
    assert parse_street("Kaltwei, 007") == ("7", "kaltwei", None, None, None)
    assert parse_street("13 Jeixrilterrace") == ("13", "jeixrilterrace", None, None, None)
    assert parse_street(None) == (None,) * 5 and parse_street(" 12 ")[:2] == ("12", None)
    assert [parse_zip(z) for z in ("ZIP 10064", "100 92", "10-002", "PC10080", "15472-0006", "12", "", None)] == ["10064", "10092", "10002", "10080", "15472", None, None, None]


def same(spark):
    a = ["12 Nalttis Street", "12 nalttis str", "Nalttis St. 12", "NO. 12, NALTTIS STREET", "12 Nalltis Street", "house 12, Nalttis, Flat 3", "12 Nalttisstreet", "c/o front desk, 12 Nalttis Street, Gerdrioth"]
    users = [(k, s, "Gerdrioth", "10001") for k, s in enumerate(a)]
    users += [(20, "12 Nalttis Street", None, "10-001"), (21, "12 Nalttis Street", "unknown", "ZIP 10001"), (22, "12 Nalttis Street, Gerdrioth", "", ""), (23, "12 Nalttis Street", "gedrioth", None)]
    others = [(30, "13 Nalttis Street", "Gerdrioth", "10001"), (31, "12 Nalttis Street", "Harnplon", "10002"), (32, "12 Plenno Square", "Gerdrioth", "10001"), (33, None, "Gerdrioth", "10001"), (34, "", "Gerdrioth", "10001"), (35, "Nalttis Street", "Gerdrioth", "10001"), (36, "12 Nalttis Street", None, None), (37, "x" * 50000, "Gerdrioth", "10001"), (None, a[0], "Gerdrioth", "10001")]
    df = spark.createDataFrame([(*u, 1, "clash", "clash") for u in users + others + users[:2]], USER)
    ref = spark.createDataFrame([(1, "Gerdrioth", None, "KD"), (2, "Harnplon", None, "VN")], REF)
    return df, ref, sorted(u[0] for u in users)


def test_same_building(spark):
    df, ref, ids = same(spark)
    got = [tuple(r) for r in same_building(df, ref).collect()]
    assert len(got) == len(set(got)) and set(got) == set(combinations(ids, 2))


def test_levels_stay_explicit(spark):
    df, ref, _ = same(spark)
    kinds = spark.createDataFrame([(k, f"{k} Twin {'Road' if k % 2 else 'Lane'}", "Harnplon", "10002", 1, "", "") for k in range(50, 60)] + [(60, "5 Twin", "Harnplon", "10002", 1, "", "")], USER)
    got = {r.id: r for r in link_addresses(df.unionAll(kinds), ref).collect()}
    assert got[60].ambiguous and got[51].street == "twin road" and got[52].street == "twin lane"
    assert got[36].city is None and got[5].unit == "3" and got[35].number is None
    assert not {tuple(r) for r in same_building(kinds, ref).collect()}


def test_a_street_with_a_rare_namesake(spark):
    _, ref, _ = same(spark)
    rows = [(k, f"{k % 300} Oak Road", "Gerdrioth", "10001") for k in range(900)] + [(1000 + k, f"{k} Oak Lane", "Gerdrioth", "10002") for k in range(100)]
    rows += [(2000, "7 Oak", "Gerdrioth", "10001"), (2001, "7 Oak", "Gerdrioth", "10002"), (2002, "7 Oak", "Gerdrioth", "10003"), (2003, "8 Oak", "Gerdrioth", None)]
    # one row with a type in a zipcode of its own, and one slip of the pen
    rows += [(3000, "9 Oak Court", "Gerdrioth", "10009"), *((4000 + k, f"{k} Elm Road", "Gerdrioth", "10001") for k in range(20)), (4100, "5 Elm Lane", "Gerdrioth", "10001"), (4101, "5 Elm", "Gerdrioth", "10001")]
    df = spark.createDataFrame([(*r, 1, "", "") for r in rows], USER)
    got = {r.id: r for r in link_addresses(df, ref).collect()}
    assert len(got) == len(rows)
    assert [got[k].street for k in (7, 1007, 2000, 2001, 3000, 4005, 4100, 4101)] == ["oak road", "oak lane", "oak road", "oak lane", "oak court", "elm", "elm", "elm"]
    assert [k for k in got if got[k].ambiguous] == [2002, 2003]
    pairs = {tuple(r) for r in same_building(df, ref).collect()}
    assert {(7, 2000), (7, 307), (1007, 2001), (4005, 4100)} <= pairs and not {(7, 1007), (9, 3000), (7, 2002)} & pairs


def test_long_names_and_long_chains(spark):
    letters = "abcdefghij"
    rows = []
    for size in (59, 60, 61, 62, 63, 200, 3000):
        word = "".join(letters[(k * k + k // 7 + size) % 10] for k in range(size))
        at = size // 3
        rows += [(size, word)] * 9 + [(size, word[:at] + word[at + 1 :]), (size, word[:at] + "z" + word[at:]), (size, word[:5] + word[6:-3] + "z" + word[-3:]), (size, word[:at] + "zz" + word[at + 2 :])]
    # each spelling is one deletion from the next only, which occurs more often
    chain = ["q" * k + "w" * (40 - k) for k in range(0, 40, 1)]
    rows += [(1, name) for k, name in enumerate(chain) for _ in range(k + 1)]
    got = {(r.city, r.name): r.root for r in link_streets(spark.createDataFrame(rows, "city long, name string")).collect()}
    assert {got[1, c] for c in chain} == {chain[-1]}
    for size in (59, 60, 61, 62, 63, 200, 3000):
        word = next(w for c, w in rows if c == size)
        far = word[: size // 3] + "zz" + word[size // 3 + 2 :]
        roots = {w: r for (c, w), r in got.items() if c == size}
        assert roots.pop(far) == far and len(roots) == 4 and set(roots.values()) == {word}, size


def test_streets_that_resemble_each_other(spark):
    rows = [(1, "march", "10001")] * 20 + [(1, "marsh", "10002")] * 30 + [(1, "marh", "10001"), (1, "marxh", "10002"), (1, "marh", "10001"), (1, "mars", None)]
    rows += [(2, "march", "10001")] * 20 + [(2, "marsh", "10001")] * 30 + [(3, "march", None)] * 20 + [(3, "marsh", "10001")] * 30
    got = {(r.city, r.name): r.root for r in link_streets(spark.createDataFrame(rows, "city long, name string, zip string")).collect()}
    # told apart by zipcodes of their own; not where they share one or none is known
    assert {n: got[1, n] for n in ("march", "marsh", "marh", "marxh", "mars")} == {"march": "march", "marsh": "marsh", "marh": "march", "marxh": "marsh", "mars": "marsh"}
    assert got[2, "march"] == "marsh" and got[3, "march"] == "marsh"


def test_region_of_an_unseen_zipcode(spark):
    rows = [(1, "1 Plenno Square", "Gerdrioth", "10001"), (2, "1 Plenno Square", None, "10077"), (3, "1 Plenno Square", "Harnplon", "10202"), (4, "1 Plenno Square", "Gerdrioth", "10303"), (5, "1 Plenno Square", "Harnplon", "10304"), (6, "1 Plenno Square", "xxx", "10305")]
    _, ref, _ = same(spark)
    got = {r.id: r.city for r in link_addresses(spark.createDataFrame([(*r, 1, "", "") for r in rows], USER), ref).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: 2, 6: None}


def test_empty(spark):
    df, ref, _ = same(spark)
    assert same_building(df.limit(0), ref).count() == 0
    assert same_building(df, ref.limit(0)).count() == 0
