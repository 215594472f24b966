from kittiwake.llm.disclosure import disclosing_spans, sanitise

USER = "id long, name string, email string, street string, city string, description string, terms int, kind string"
REF = "city_id long, city_name string, alt_name string"
CASES = [
    ("Reach me at skik+nok@peik.example, please.", [("email", "skik+nok@peik.example")]),
    ("cc dolpas (at) plem dot mail dot test on every purge", [("email", "dolpas (at) plem dot mail dot test")]),
    ("Write to sda AT varon DOT example.", [("email", "sda AT varon DOT example")]),
    ("Text me, +990 49 555 0525. p99@load stays under 92 ms.", [("phone", "+990 49 555 0525")]),
    ("Ring (609) 555-0190 or knock.", [("phone", "(609) 555-0190")]),
    ("tel:+999-69-555-6319 ext. 81", [("phone", "+999-69-555-6319 ext. 81")]),
    ("National ID 902-80-0821. Order 49-4212-98 is closed.", [("idno", "902-80-0821")]),
    ("Passport AY 67 7448 9338 on file.", [("idno", "AY 67 7448 9338")]),
    ("Lives at 116 Ranbek Square, Great Worfle 15305.", [("address", "116 Ranbek Square, Great Worfle 15305")]),
    ("Parcels to Rovesk Street 303, 36768 Brethkei, thanks.", [("address", "Rovesk Street 303, 36768 Brethkei")]),
    ("Works with Dr. Jion Skekpaeth-Drioth on codecs.", [("person", "Jion Skekpaeth-Drioth")]),
    ("trained by P. Drioth, mostly", [("person", "P. Drioth")]),
    ("Shares a desk with Drioth, Jion.", [("person", "Drioth, Jion")]),
    ("Reports to jion drioth.", [("person", "jion drioth")]),
    ("Uses Quick Ledger 8 daily. Runs 4 shards @ 40% load.", []),
    ("Last audit: 2026-01-17 03:15:57. Checksum 6f1a-28c1-0d56 was fine.", []),
]


def frame(spark):
    rows = [(k, "Jion Drioth", f"u{k}@peik.example", "12 Ranbek Square", "Brethkei", text) for k, (text, _) in enumerate(CASES * 3)]
    rows += [(200 + k, "Skekpaeth Jion", f"v{k}@varon.test", "3 Rovesk Street", "Great Worfle", x) for k, x in enumerate([None, "", "Keeps the nightly merge. Reports to work on time."] * 8)]
    rows += [(300, None, None, None, None, "plain word " * 20000), (None, "Jion", "x@y.test", "", "", "Reach me at a@b.test")]
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], USER), spark.createDataFrame([(1, "Great Worfle", None), (2, "Brethkei", "Old Bre"), (3, None, None)], REF)


def test_cases(spark):
    users, ref = frame(spark)
    found = {}
    for r in disclosing_spans(users, ref).collect():
        found.setdefault(r.id, []).append((r.start, r.stop, r.kind, r.found))
    for k, (text, want) in enumerate(CASES * 3):
        assert sorted((kind, x) for _, _, kind, x in found.get(k, [])) == sorted(want), text
        assert all(text[a:b] == x for a, b, _, x in found.get(k, []))
    assert not [k for k in found if k >= len(CASES) * 3]


def test_text_around_stays(spark):
    users, ref = frame(spark)
    clean = {r.id: r.text for r in sanitise(users, ref).collect() if r.id is not None}
    assert clean[0] == "Reach me at [EMAIL], please." and clean[4] == "Ring [PHONE] or knock." and clean[14] == CASES[14][0]
    assert clean[8] == "Lives at [ADDRESS]." and clean[10] == "Works with Dr. [PERSON] on codecs." and clean[6] == "National ID [ID]. Order 49-4212-98 is closed."
    assert [r.text for r in sanitise(users, ref).where("id IS NULL").collect()] == ["Reach me at [EMAIL]"]
    assert clean[200] is None and clean[201] == "" and clean[300] == "plain word " * 20000


def test_empty(spark):
    users, ref = frame(spark)
    assert disclosing_spans(users.limit(0), ref).count() == 0
    assert {r.kind for r in disclosing_spans(users, ref.limit(0)).collect()} == {"email", "phone", "idno", "address", "person"}


def test_a_label_decides_before_the_form(spark):
    _, ref = frame(spark)
    texts = [f"Row {100000000 + k} was merged." for k in range(60)] + ["Passport 123456789 on file.", "Phone 223456789 after noon."]
    texts += [f"Ring 55-{1000 + k} today." for k in range(6)] + ["Badge 55-7777 is new.", "Wrote 55-8888 down."]
    users = spark.createDataFrame([(k, "Jion Drioth", "u@peik.example", "12 Ranbek Square", "Brethkei", x, 1, "") for k, x in enumerate(texts)], USER)
    got = {r.id: (r.kind, r.found) for r in disclosing_spans(users, ref).collect()}
    assert got == {60: ("idno", "123456789"), 61: ("phone", "223456789"), **{62 + k: ("phone", f"55-{1000 + k}") for k in range(6)}, 68: ("idno", "55-7777"), 69: ("phone", "55-8888")}


def test_the_measure_decides_what_looks_like_a_name(spark):
    _, ref = frame(spark)
    texts = [f"Works with {who} on codecs." for who in ("Jion Drioth", "Skekpaeth Jion", "Quick Ledger", "Quick Ledger", "Index Doctor", "Index Doctor") for _ in range(12)]
    texts += ["Works with Plarn Oxtrui on codecs.", "Works with Quick Oxtrui on codecs."]
    users = spark.createDataFrame([(k, "Jion Drioth" if k % 2 else "Skekpaeth Jion", "u@peik.example", "12 Ranbek Square", "Brethkei", x, 1, "") for k, x in enumerate(texts)], USER)
    got = {r.id: r.found for r in disclosing_spans(users, ref, name_cue_share=0.3).collect()}
    # words that are never in names are ordinary where they are frequent, and are taken after a telling word where not
    assert set(got.values()) == {"Jion Drioth", "Skekpaeth Jion", "Plarn Oxtrui"} and len(got) == 25
    every = {r.found for r in disclosing_spans(users, ref, threshold_bits=-100.0).collect()}
    assert {"Quick Ledger", "Index Doctor"} <= every
    none = disclosing_spans(users, ref, threshold_bits=50.0).collect()
    assert none == []


def test_emails_are_weighed_by_their_own_parts(spark):
    _, ref = frame(spark)
    texts = ["Reach me at skik@peik.example please."] * 6 + ["Load is p99@load.stats today."] * 30
    users = spark.createDataFrame([(k, "Jion Drioth", f"skik{k}@peik.example", "12 Ranbek Square", "Brethkei", x, 1, "") for k, x in enumerate(texts)], USER)
    assert {r.found for r in disclosing_spans(users, ref).collect()} == {"skik@peik.example"}


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    users, ref = frame(spark)
    two = [(900, "Jion Drioth", "", "", "", x, 1, "") for x in ("Ring (609) 555-0190 or knock.", "Works with Dr. Jion Drioth, ring (609) 555-0191 now.", "Works with Dr. Jion Drioth, ring (609) 555-0191 now.")]
    clean = [r.text for r in sanitise(users.unionAll(spark.createDataFrame(two, USER)), ref).where("id = 900").collect()]
    assert sorted(clean) == ["Ring [PHONE] or knock.", "Works with Dr. [PERSON], ring [PHONE] now.", "Works with Dr. [PERSON], ring [PHONE] now."]
