"""Problem 2 on pages made from clean prose: held-out documents, every kind of noise."""

import random

from thicket.llm import scans as S

STEMS = "manual record window carton number supply review monthly returns planner quarter meeting section storage release minutes follows between against quality".split()
WORDS = [a + b for a in STEMS for b in ("", "s", "ed", "ing", "er")] + ["lock-screen", "follow-up", "price-list"]
CONFUSIONS = [("o", "0"), ("l", "1"), ("s", "5"), ("rn", "m"), ("m", "rn"), ("e", "c"), ("b", "6"), ("w", "vv")]


def prose(rng, sentences):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 12))).capitalize() + "." for _ in range(sentences))


def page_doc(rng, i):
    """A scanned document, its noise, and its clean text."""
    title = f"{rng.choice(STEMS).capitalize()} {rng.choice(STEMS)} plan"
    text = prose(rng, 40)
    noise, lines = set(), [f"# {title}", ""]
    number, on_page = rng.randint(3, 60), 0
    line = ""
    for w in text.split():
        bare = w.strip(".").lower()
        if len(bare) > 5 and "-" not in bare and rng.random() < 0.04:
            a, b = rng.choice([c for c in CONFUSIONS if c[0] in bare] or [("", "")])
            if a and bare.replace(a, b, 1) not in WORDS:
                w = w[0] + w[1:].replace(a, b, 1) if a in w[1:] else w
                if w.strip(".").lower() != bare:
                    w = "\x01" + w
        clean = w.lstrip("\x01")
        if len(line) + len(clean) > 58:
            room = 58 - len(line) - 2
            if "-" not in clean and 3 <= room <= len(clean) - 4:
                line += " " + w[: room + w.count("\x01")] + "-"
                noise.add((len(lines) + 1, "hyphen"))
                w = clean[room:]
            if "\x01" in line:
                noise.add((len(lines) + 1, "misread"))
            lines.append(line.replace("\x01", ""))
            on_page += 1
            line = w
            if on_page == 12:
                for text_line, kind in (("", None), ("Form 12 of the central archive", "running"), (f"- {number} -", "page_no"), (title, "running"), ("", None)):
                    lines.append(text_line)
                    if kind:
                        noise.add((len(lines), kind))
                number, on_page = number + 1, 0
        else:
            line = f"{line} {w}".strip()
    if "\x01" in line:
        noise.add((len(lines) + 1, "misread"))
    lines.append(line.replace("\x01", ""))
    return (i, "\n".join(lines)), noise, f"# {title}\n\n{text}"


def corpus(n=60):
    rng = random.Random(6)
    docs, truth, clean = [], set(), {}
    for i in range(n):
        d, noise, text = page_doc(rng, i)
        docs.append(d)
        truth |= {(i, *x) for x in noise}
        clean[i] = text
    docs += [(1000 + i, f"# {rng.choice(STEMS)}\n\n" + "\n\n".join(prose(rng, 12) for _ in range(4))) for i in range(120)]
    return docs, truth, clean


def finder(patterns=frozenset({"Form 9 of the central archive"})):
    """A finder of running lines trained on the documents of the corpus."""
    m = S.Margins(set(patterns))
    m.train([x for _, t in corpus()[0] if S.scanned(t) for x in m.sure(S.Page(t.split("\n")))])
    return m


def test_noise_and_repair(spark):
    docs, truth, clean = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "load_id long, t string, k string")
    got = {tuple(r) for r in S.noisy_lines(df, "load_id", "t").collect()}
    for kind in ("hyphen", "running", "page_no", "misread"):
        a, b = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert len(b) > 50 and len(a & b) >= 0.95 * len(b) and len(a & b) >= 0.95 * len(a), (kind, len(a), len(b), sorted(b - a)[:3], sorted(a - b)[:3])
    out = {r["load_id"]: r["repaired"] for r in S.repaired(df, "load_id", "t").collect()}
    assert all(out[i] == t for i, t in docs if i >= 1000)
    same = sum(a == b for i in clean for a, b in zip(out[i].split(), clean[i].split()))
    assert same >= 0.99 * sum(len(c.split()) for c in clean.values())


def test_one_long_line_in_a_scanned_document():
    (_, text), *_ = page_doc(random.Random(2), 1)
    address = "As Ann told the archive keeper, the tenant at 69, rue des Trois-Moulins, 99817 Pont-l'Orme moved out of the house."
    assert len(address) > 100 and S.scanned(text) and S.scanned(f"{text}\n\n{address}\n") and S.scanned(text.replace("\n\n", f"\n\n{address}\n\n", 2))
    clean = "\n\n".join(prose(random.Random(3), 12) for _ in range(4))
    assert not S.scanned(clean) and not S.scanned(f"# Plan\n\nA short line\n\n- x\n- y\n\nDear all,\nhello\n\n{clean}")
    found = S.noise(f"{text}\n\n{address}\n", S.Editor({}, {}), finder())[1]
    assert {"running", "page_no"} <= set(found.values())


def test_running_lines_of_any_length():
    """Longer than the page is wide, in one document only, known from its place and its return."""
    (_, text), noise, _ = page_doc(random.Random(4), 1)
    long = "Issued by the central archive on behalf of the committee for storage, supply and quality, third edition of the year, for use in house"
    lines = text.replace("Form 12 of the central archive", long).split("\n")
    assert sum(x == long for x in lines) >= 3
    kind = S.furniture(lines, finder(()))
    assert {(i + 1, k) for i, k in kind.items()} == {x for x in noise if x[1] in ("running", "page_no")}


def vocabulary():
    return {w: 40 + 7 * (i % 9) for i, w in enumerate(WORDS)}


def spoiled(words):
    return [(w.replace(a, b, 1), w) for w in words for a, b in CONFUSIONS if a in w[1:-1] and w.replace(a, b, 1) not in WORDS]


def test_the_training_decides():
    """Untrained, the editor edits nothing; trained, it mends words it knows and some it doesn't, and leaves strange ones."""
    channel = {(b, a): 50.0 for a, b in CONFUSIONS}
    kept_out = set(WORDS[2::9])
    known = {w: n for w, n in vocabulary().items() if w not in kept_out}
    idle, editor = S.Editor(known, channel), S.Editor(known, channel)
    editor.train()
    pairs = spoiled(w for w in known if len(w) > 4 and "-" not in w)
    assert all(idle.meant(bad) is None for bad, _ in pairs)
    assert sum(editor.meant(bad) == good for bad, good in pairs) >= 0.95 * len(pairs)
    assert sum(editor.meant(w) is not None for w in WORDS if "-" not in w) <= 0.03 * len(WORDS)
    strange = spoiled(w for w in kept_out if len(w) > 5 and "-" not in w)
    mended = sum(editor.meant(bad) == good for bad, good in strange)
    assert mended >= 0.3 * len(strange)
    assert not idle.joins("stor", "-", "age") and editor.joins("stor", "-", "age") and not editor.joins("lock", "-", "screen")


def test_decoys():
    m = finder()
    lines = "# Plan\n\nIn all the stock came to\nTotal carton count:\n796\n\n- 3 -\nmore text\n- 4 -\nend".split("\n")
    assert S.furniture(lines, m) == {6: "page_no", 8: "page_no"}
    assert S.furniture("# Plan\n\nkept in hall\n3.\n\nPlan\n- 4 -".split("\n"), m) == {5: "running", 6: "page_no"}
    assert S.furniture("```\n7\n```\ntext\n8".split("\n"), m).get(1) is None


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50_000), (4, "\n" * 2_000), (5, "a-\n"), (None, "Page 3\nx")], "load_id long, t string")
    got = [tuple(r) for r in S.noisy_lines(df, "load_id", "t").collect()]
    assert got == [(None, 1, "page_no")]
    assert {r["load_id"] for r in S.repaired(df, "load_id", "t").collect()} == {3, 4, 5, None}
    assert S.noisy_lines(df.where("false"), "load_id", "t").count() == 0 and S.repaired(df.where("false"), "load_id", "t").count() == 0


def test_average():
    p = S.Perceptron()
    for _ in range(20):
        p.learn([("a", ["x"]), ("b", ["y"])], 1)
    p.average()
    assert p.best([("a", ["x"]), ("b", ["y"])]) == 1
