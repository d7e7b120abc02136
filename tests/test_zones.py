"""Zones among lines, and their repair, against plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from lakescreen.functions import mrz

SWAP = {"0": "O", "1": "I", "2": "Z", "5": "S", "6": "G", "8": "B", "O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "Z": "2", "S": "5", "B": "8", "G": "6"}


def digit(payload):
    return str(sum(max(0, mrz.ALPHABET.find(c)) * (7, 3, 1)[i % 3] for i, c in enumerate(payload)) % 10)


def tried(read, want):
    places = [i for i, c in enumerate(read) if c in mrz.AMBIGUOUS][:8]
    for picks in itertools.product((0, 1), repeat=len(places)):
        # product counts with its last place as the lowest bit
        text = "".join(SWAP[c] if i in places and picks[::-1][places.index(i)] else c for i, c in enumerate(read))
        if digit(text) == want:
            return text
    return read


def test_repair_tries_every_exchange_in_order(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ODQILZSBG015286AKX347<") for _ in range(rng.choice((1, 4, 9, 9, 14)))), rng.choice("0123456789")) for _ in range(400)]
    rows += [("", "1"), ("AKX", "1"), ("O", "<"), ("O", None), (None, "1"), ("l 8989o2c3", "6")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, read string, digit string").select("i", mrz.repair(F.col("read"), F.col("digit")).alias("r"))
    got = dict(got.collect())
    for i, (read, want) in enumerate(rows[:400]):
        assert got[i] == tried(read, want), (read, want)
    assert [got[i] for i in range(400, 406)] == ["", "AKX", "O", "O", None, tried("L8989O2C3", "6")]


TOP, BOTTOM = "P<UT0SMITH<<ALICE<JANE".ljust(44, "<"), "L8989O2C36UTO74O8l22F28O4l52" + "<" * 15 + "0"
VISA, STAY = "V<UTOERIKSSON<<ANNA<MARIA".ljust(36, "<"), "L8988901C4UTO4009078F9612109M90<<<<<"
CARD, BACK = "I<UTOERIKSSON<<ANNA<MARIA".ljust(36, "<"), "D2314589" + digit("D2314589") + "<UTO7408122F1204159<<<<<<<6"
ONE = ("I<UTOD231458907".ljust(30, "<"), "7408122F1204159UTO".ljust(30, "<"), "ERIKSSON<<ANNA<MARIA".ljust(30, "<"))


def formats(spark, pages):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, lines array<string>").select("i", mrz.zone(F.col("lines")).alias("z"))
    return [r.z for r in rows.orderBy("i").collect()]


def test_zones_are_pairs_of_neighbouring_candidates(spark):
    noise, short, long = "X" * 33, "SHORT", "<" * 60
    found = formats(spark, [
        [noise, TOP, BOTTOM],  # a candidate before the pair
        [short, TOP, short, long, BOTTOM, noise],  # lines of other lengths between do not part the pair
        [TOP, noise, BOTTOM],  # another candidate between does
        [TOP[:41], BOTTOM[:42]], [VISA, STAY], [CARD[:35], BACK[:36].ljust(36, "<")], [noise, *ONE], [ONE[0], ONE[1]], [CARD[:34], noise + "YY", TOP, BOTTOM],
        [], [None, "x"], None, ["A" * 30] * 3,
    ])
    assert [z and z.format for z in found] == ["TD3", "TD3", None, "TD3?", "MRV-B", "TD2", "TD1", None, "TD3", None, None, None, None]
    assert (found[1].first, found[1].second, found[1].third) == (TOP, BOTTOM, None) and found[6].third == ONE[2]


def test_a_misread_zone_is_repaired(spark):
    pages = [[TOP, BOTTOM], [VISA, STAY.replace("L898890", "L89889O")], [CARD, BACK.ljust(36, "<")], list(ONE), ["nothing"]]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, lines array<string>")
    got = [r.z for r in rows.select("i", mrz.read_zone(mrz.zone(F.col("lines")), F.lit("2025-01-01").cast("date")).alias("z")).orderBy("i").collect()]
    p, v, c, o, n = got
    assert (p.format, p.issuer, p.surname, p.given_names, p.number, p.number_ok, p.date_of_birth, p.birth_ok, p.expiry_date, p.expiry_ok) == (
        "TD3", "UTO", "SMITH", "ALICE JANE", "L898902C3", True, "1974-08-12", True, "2028-04-15", digit("280415") == "2")
    assert (v.format, v.number, v.number_ok, v.entries, v.stay, v.composite_ok) == ("MRV-B", "L8988901C", True, "multiple", "90 days", None)
    assert (c.format, c.number, c.number_ok, c.surname, c.entries) == ("TD2", "D2314589", True, "ERIKSSON", None)
    assert (o.format, o.number, o.number_ok, o.date_of_birth, o.birth_ok) == ("TD1", "D23145890", True, "1974-08-12", True)
    assert n is None
