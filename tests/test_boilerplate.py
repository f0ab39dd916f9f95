"""One fixture a rule, and windows that meet none."""

import random

import pytest
from caseload.functions import boilerplate as B
from pyspark.sql import functions as F

PLAIN = " ".join("we walked along the river and talked about the harvest of last year and how the weather had changed since then".split() * 1)
LONG = "\n".join(["From the hills you could see every village in the valley", "and nobody remembered a summer as dry as that one", "so they carried water from the old mill each evening", "while children slept beneath the chestnut trees outside", "waiting for rain that would come only in late September"])
CONTINUED = "The miller told them stories about his youth abroad. They listened until the lamps went out, then slowly went home through quiet lanes."

CASES = {
    "none": (LONG, CONTINUED, []),
    "disclaimer": (LONG, "This note is meant for its readers. If you have received this by mistake please call us.", ["disclaimer"]),
    "disclaimer by words": (LONG, "It is confidential and privileged, its copying and any distribution among others is a matter of trust.", ["disclaimer"]),
    "disclaimer begun before": (LONG + " Please notify the sender", "or return it to the addressee at once with all pages in their order.", ["disclaimer"]),
    "signature": (LONG, "Bring the papers tomorrow.\nRegards,\nAnn Lee\nTel 555-123-4567 call\nann@river.org\nwww.river.org", ["signature"]),
    "sent from": (LONG, "I shall come by train tomorrow. Sent from my iPhone while walking home from work.", ["signature"]),
    "quoted": (LONG, "See below.\nFrom: Ann Lee\nSent: Monday\nThe rest follows in the message that she wrote.", ["quoted_header"]),
    "forwarded": (LONG, "Look at this one.\n-----Original Message-----\nIt came this morning from the office downtown.", ["quoted_header"]),
    "footer": (LONG, "You can unsubscribe at any time by writing to our office in the capital.", ["list_footer"]),
    "footer by words": (LONG, "Click here for the summer list and enjoy free shipping on whatever you choose.", ["list_footer"]),
    "bounce": (LONG, "Your message could not be delivered because the house has moved away.", ["auto_message"]),
    "scan": (LONG, "This letter has been scanned and found to be in good order by the clerk.", ["scan_notice"]),
    "stamp": (LONG, "The page says subject to protective order and then the text goes on quietly.", ["production_stamp"]),
    "repeats": (LONG, "one more time we sing " * 6, ["repetitive"]),
    "copied": (LONG, "Then " + " ".join(LONG.split()[4:24]) + " again.", ["repetitive"]),
    "files": (LONG, "They sent the yearly report.pdf together with another table.html and then photo.jpg in one bundle before the evening came.", ["key_value_list"]),
    "keys": (LONG, "Colour: red\nSize: large\nPlace: north\nOwner: mill", ["key_value_list"]),
    "names": (LONG, "Lee, Ann; Roe, Bob; Fox, Carl; Day, Dora; Orr, Emil; Poe, Fay; and others came.", ["tabular"]),
    "numbers": (LONG, "north 1.5 2.5 3.5\nsouth 4.5 5.5 6.5\neast 7.5 8.5 9.5\nwest\nend", ["tabular"]),
    "garbled": (LONG, "the xkcdvb of bcdfgh was qwrtzp and then hjklmn came with zxcvbn as ever", ["ocr_garbage"]),
    "thin": ("short note before", CONTINUED, ["thin_prefix"]),
    "header just before": ("From: a\nTo: b\n\nshort note", CONTINUED, ["quoted_header", "thin_prefix"]),
    "null": (None, None, ["thin_prefix"]),
}


@pytest.fixture(scope="module")
def got(spark):
    rows = spark.createDataFrame([(k, p, t) for k, (p, t, _) in CASES.items()], "k string, p string, t string")
    return {r["k"]: r["r"] for r in rows.select("k", B.window_reasons(F.col("p"), F.col("t")).alias("r")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_rules(got, name):
    assert got[name] == CASES[name][2]


def test_only_messages_have_the_rules_of_messages(spark):
    rows = spark.createDataFrame([(p, t) for p, t, _ in CASES.values()], "p string, t string")
    met = {x for r in rows.select(B.window_reasons(F.col("p"), F.col("t"), False).alias("r")).collect() for x in r["r"]}
    assert met == {"production_stamp", "repetitive", "key_value_list", "tabular", "ocr_garbage"}


def test_known_words_are_no_garbage(spark):
    p, t, _ = CASES["garbled"]
    known = sorted(set((p + " " + t).lower().split()))
    row = spark.createDataFrame([(p, t, known), (p, CONTINUED, known[:5])], "p string, t string, k array<string>").select(B.window_reasons(F.col("p"), F.col("t"), True, F.col("k")).alias("r")).collect()
    assert row[0]["r"] == [] and "ocr_garbage" in row[1]["r"]


def test_windows_that_stand_elsewhere(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("aeioulmnrst") for _ in range(6))
    lead, form, whole = (" ".join(word() for _ in range(70)) for _ in range(3))
    own = [" ".join(word() for _ in range(70)) for _ in range(12)]
    docs = [(i, own[i] + " " + form) for i in range(5)] + [(10 + i, lead + " " + whole) for i in range(6)] + [(20, own[9] + " " + own[10])]
    windows = [(1, own[0], form), (2, lead, whole), (3, own[9], own[10])]
    held = B.with_run_counts(spark.createDataFrame(windows, "w long, prefix string, target string"), spark.createDataFrame(docs, "doc_id long, text string"), ["w"])
    got = held.select("w", F.size("after").alias("n"), B.window_reasons(F.col("prefix"), F.col("target"), True, None, F.col("after"), F.col("before")).alias("r")).collect()
    assert {r["w"]: r["r"] for r in got} == {1: ["corpus_template"], 2: ["duplicate"], 3: []} and {r["n"] for r in got} == {63}
