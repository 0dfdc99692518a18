"""Problem 6 on texts written for the purpose."""

import random

import numpy as np
from pyspark.sql import functions as F

from thicket.llm import pii

GIVEN, FAMILY = ["Anna", "Mark", "Will", "Rose", "Oskar"], ["Velmorrow", "Brüllendorf", "Quennix"]
PLACES = ["12 Elm Tree Road, Upton 99123", "7 bis, rue du Four, 99001 Valmont", "Birkenstraße 4a, 99300 Musterau", "P.O. Box 88, Upton 99123"]


FILLER = [
    "The green hall is closed and the market square is open.", "A quiet river runs past the old theatre.", "Some pumps need oil, others need a new seal.", "Die Werkstatt prüft den Auftrag am Montag.", "Le dossier du service est complet.",
    "La oficina guarda el permiso nuevo.", "Walnut Street was closed.", "It rained yesterday, and nobody came.", "The report lists the stock of the north depot; 12 Elm Tree Road is a detour.", "Der Wartungsplan liegt im Schrank.", "Hall 4 Gate is locked.",
]
#: Frames that occur nowhere in the code, nor in the texts that the labelers learn from.
HELD_OUT = [
    ("The laptop of {name} was stolen.", "name"), ("We met {name} in the hall.", "name"), ("Notes written by {name} are kept.", "name"), ("Yesterday {name} sang well.", "name"), ("Nobody but {name} knew it.", "name"),
    ("The winner is {name}, as expected.", "name"), ("{name} paid for it.", "name"), ("Ask whether {name} agrees!", "name"), ("It arrived at {address} last week.", "address"), ("From {address} it is a short walk.", "address"),
    ("Ring {phone} if it rains.", "phone"), ("You reach us under {phone} at night.", "phone"), ("Forward it to {mail} soon.", "email"), ("{mail} bounced twice.", "email"), ("Her passport number {number} has expired.", "id_number"), ("On the card: SSN {number}, valid.", "id_number"),
]
INNOCENT = ["The version 2026-07-25 17 is void.", "See order 2792508410 for the green hall.", "The Market Square was full.", "Old Theatre tickets are sold at shelf 912-34-5678.", "Run pkg@4.1.9 in the shell.", "20 Walnut Street is a song.", "Look at the dot on it.", "Section 912 34 5678 is blank."]


def sample(rng, listed=0.6):
    g = rng.choice(GIVEN) if rng.random() < listed else rng.choice(["Petrus", "Nadja", "Ilona"])
    f = rng.choice(FAMILY) if rng.random() < listed else rng.choice(["Tarnholt", "Osterveen", "Maldivane"])
    return {
        "name": rng.choice([f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{f.upper()} {g}", f"{g} B. {f}"]), "address": rng.choice(PLACES),
        "phone": rng.choice(["+44 20 7946 0123", "(415) 555-0134", "212.555.0199", "030/23125444", "0013055550143"]), "number": rng.choice(["912-34-5678", "XQ1234567", "00 844 940 914"]),
        "mail": rng.choice([f"{g.lower()}@post.example.org", "desk (at) north.example", "x [at] mail [dot] example [dot] org", "A.B@MAIL.EXAMPLE"]),
    }


def held_out():
    """Texts to learn from, and 400 in frames of their own."""
    rng = random.Random(8)
    out = [*sentences()]
    for i in range(400):
        x = sample(rng)
        if i % 5 == 4:
            out.append((2000 + i, rng.choice(INNOCENT), []))
            continue
        frame, kind = rng.choice(HELD_OUT)
        value = x[{"email": "mail", "id_number": "number"}.get(kind, kind)]
        out.append((2000 + i, frame.format(**x), [(kind, value)]))
    return out


def sentences():
    rng = random.Random(3)
    out = [(10_000 + i, rng.choice(FILLER), []) for i in range(200)]
    for i in range(240):
        x = sample(rng)
        name, phone, number, mail = x["name"], x["phone"], x["number"], x["mail"]
        out.append((i, *rng.choice(
            [
                (f"Dear Mr {name}, your request AB-1234 is ready.", [("name", name)]), (f"Contact: {name}, {phone}.", [("name", name), ("phone", phone)]), (f"Passport no. {number} was shown at the gate by {name}.", [("id_number", number), ("name", name)]),
                ("Write to [the desk](mailto:anna@post.example.org) for a copy.", [("email", "anna@post.example.org")]), (f"Questions go to {mail} before 12 May.", [("email", mail)]), (f"Please send the parcel to {name}, {x['address']}.", [("name", name), ("address", x["address"])]),
                (f"| a | {name} |\n| b | {phone} |", [("name", name), ("phone", phone)]), ("Part no. 912-34-5678 fits the older pump.", []), ("Order 2792508410 was split, sheet 2026-07-25 is void.", []), ("Section 12 Road markings. Mark the page, then grant access; will the rose stay?", []), ("The @retry marker wraps tool@4.1.9 in the file. Velmorrow Pumps is a firm.", []),
            ]
        )))
    return out


def table(spark, rows):
    names = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [(None, "given")], "name string, kind string")
    return spark.createDataFrame([(r[0], r[1], 0) for r in rows], "k long, t string, a int"), names


def test_found(spark):
    rows = sentences()
    df, names = table(spark, rows)
    got = {(r["k"], r["pii_type"], r["start_pos"]) for r in pii.spans(df, ["k"], "t", names).collect()}
    want = {(i, kind, t.index(s) + 1) for i, t, span in rows for kind, s in span}
    hit = len(got & want)
    assert hit >= 0.97 * len(want) and hit >= 0.97 * len(got), (sorted(want - got)[:5], sorted(got - want)[:5])


def test_held_out_frames(spark):
    rows = held_out()
    df, names = table(spark, rows)
    got = {(r["k"], r["pii_type"], r["start_pos"]) for r in pii.spans(df, ["k"], "t", names).where("k between 2000 and 2999").collect()}
    want = {(i, kind, t.index(s) + 1) for i, t, span in rows if 2000 <= i < 3000 for kind, s in span}
    hit = len(got & want)
    assert hit >= 0.95 * len(want) and hit >= 0.95 * len(got), (hit, len(want), len(got), [(x, t) for x in sorted(want ^ got) for i, t, _ in rows if i == x[0]][:30])


def test_votes_reject(spark):
    """Candidates of every type are turned down."""
    df, names = table(spark, held_out())
    proposed, judge = pii.proposals(df, ["k"], "t", names)
    down = {pii.TYPES[c["type"]] for r in proposed.collect() for c in r["found"] if judge.probability(c["type"], c["f"]) < 0.5}
    assert down == set(pii.TYPES)


def test_whole_lines(spark):
    """No look-back is too short for an address."""
    word = "Langer" * 40
    rows = [*sentences(), (900, f"At 12 {word} Road, Upton 99123 it is.", [])]
    df, names = table(spark, rows)
    got = {(r["pii_type"], r["start_pos"]) for r in pii.spans(df, ["k"], "t", names).where("k = 900").collect()}
    assert got == {("address", 4)}


def test_disguised(spark):
    rows = [*sentences(), (900, "Сontact: Аnna Velmо​rrow, +44\xa020\xa07946\xa00123.", []), (901, "Mail Ａnna＠post.example now", [])]
    df, names = table(spark, rows)
    got = {(r["k"], r["pii_type"], r["start_pos"], r["end_pos"]) for r in pii.spans(df, ["k"], "t", names).where("k >= 900").collect()}
    assert (900, "name", 10, 24) in got and (900, "phone", 27, 42) in got and (901, "email", 6, 22) in got


def test_redacted(spark):
    rows = sentences()
    df, names = table(spark, [*rows, (999, "nothing here", []), (1000, None, [])])
    out = {r["k"]: r["redacted"] for r in pii.redact(df, ["k"], "t", pii.spans(df, ["k"], "t", names)).collect()}
    first = next(i for i, t, _ in rows if t.startswith("Dear Mr"))
    assert out[first] == "Dear Mr [NAME], your request AB-1234 is ready." and out[999] == "nothing here" and out[1000] is None
    both = next(i for i, t, _ in rows if t.startswith("Contact:"))
    assert out[both] == "Contact: [NAME], [PHONE]."


def test_edges(spark):
    long = "word " * 100_000 + "a@b.example"
    df, names = table(spark, [(1, None), (2, ""), (3, long), (4, "a@b.example"), (4, "a@b.example"), (None, "a@b.example")])
    got = sorted(((r["k"], r["start_pos"]) for r in pii.spans(df, ["k"], "t", names).collect()), key=str)
    assert got == sorted([(3, 500_001), (4, 1), (4, 1), (None, 1)], key=str)
    assert pii.spans(df.where("false"), ["k"], "t", names).count() == 0
    assert pii.spans(df.where(F.col("k") == 4), ["k"], "t", names.where("false")).count() == 2


def test_estimates():
    votes = np.array([[1, 1], [1, 0], [0, 0], [-1, 0], [-1, -1]])
    p = pii.expectation_maximisation(votes, np.array([50.0, 20, 5, 30, 10]))
    assert p[0] > 0.9 and p[0] >= p[1] > p[3] and p[3] < 0.3 and p[4] < 0.1
