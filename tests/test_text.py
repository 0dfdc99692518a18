"""Golden strings of the cleaning, the normalisation and the redaction."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.functions import patterns as P
from thicket.functions import redaction, text

CLEAN = [
    ("Check the valve\nPAGE  12 of 40\nThen close it", "Check the valve\n\nThen close it"),
    ("end of shift\n-  7 -\nnext shift", "end of shift\n\nnext shift"),
    ("Wiring ![plan of the hall](plans/hall.svg), east side", "Wiring , east side"),
    ("<p class='n'>Oil</p> and <br/>grease", "Oil and grease"),
    ("va\x00lve", "valve"),
    ("First\n\n\n\n\nSecond", "First\nSecond"),
    ("| Part | Stock |\n|:--|--:|\n| seal | 4 |", "| Part | Stock |\n|:--|--:|\n| seal | 4 |"),
    ("first\n\nsecond", "first\n\nsecond"),
    ("x\n***\ny", "x\ny"),
    ("x\n***", "x\n***"),
    ("x\n\n***\n\ny", "x\ny"),
    ("```sh\nls -l\n```\nafter", "```sh\nls -l\nafter"),
    ("x\n\npage 2 OF 9\n\ny", "x\n\ny"),
    ("Öl\n油\nñ", "Öl\n油\nñ"),
    ("if a < b\n> said", "if a  said"),
    ("", ""),
    (None, ""),
    ("!<b>[q](r)", "![q](r)"),
]
NORMALISE = [
    ("oﬃcial ﬁles, a ﬂat roof, oﬀ", "official files, a flat roof, off"),
    ("ten\xa0litres", "ten litres"),
    ("zero​width", "zerowidth"),
    ("the main-\ntenance plan", "the maintenance plan"),
    ("wide  \t  gaps", "wide gaps"),
    ("cœur Œuvre", "coeur Œuvre"),
    ("a-\nb-\nc", "ab-\nc"),
    ("über-\né", "über-\né"),
    (None, None),
]


def apply(spark, step, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.select("i", step(F.col("t")).alias("o")).orderBy("i").collect()]


def test_clean(spark):
    assert apply(spark, text.clean, [a for a, _ in CLEAN]) == [b for _, b in CLEAN]


def test_normalise(spark):
    assert apply(spark, text.normalise, [a for a, _ in NORMALISE]) == [b for _, b in NORMALISE]


def _page_line(x: str) -> bool:
    """Page 3 of 10, or - 3 -."""
    words = x.split()
    if len(words) == 4 and words[0].lower() == "page" and words[2].lower() == "of":
        return words[1].isdecimal() and words[3].isdecimal()
    inner = x.strip()
    return len(inner) > 2 and inner[0] == inner[-1] == "-" and inner[1:-1].strip().isdecimal()


def model_clean(t: str) -> str:
    """Line by line: a run of lines without a letter or digit goes, but for the part that a pipe row follows."""
    pipe = lambda x: len(y := x.strip()) > 1 and y[0] == y[-1] == "|"
    lines, out, i = t.split("\n"), [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and not re.search(r"\w", lines[j]):
            j += 1
        if j == i:
            out.append(lines[i])
            i += 1
            continue
        ends = min(j, len(lines) - 1)  # lines of the run that a newline ends
        ahead = lambda k: next((x for x in lines[k:] if x.strip()), None)
        begin = next((k for k in range(i, ends) if (x := ahead(k)) is None or not pipe(x)), None)
        if begin is None or (ends - begin == 1 and lines[begin] == ""):
            out += lines[i:j]
        else:
            out += lines[i:begin] + lines[ends:j]
        i = j
    t = "\n".join("" if _page_line(x) else x for x in out)
    t = re.sub(r"<[^>]+>", "", re.sub(r"!\[.*?\]\(.*?\)", "", t)).replace("\0", "")
    return re.sub(r"\n{3,}", "\n\n", t).strip()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab|-# \n\t<>![]()é中1\r\x85\xa0*", max_size=40), min_size=20, max_size=60))
def test_clean_model(spark, texts):
    assert apply(spark, text.clean, texts) == [model_clean(t) for t in texts]


def test_strip_is_unicode(spark):
    spaces = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
    assert apply(spark, P.strip, [f"{spaces}a{spaces}"]) == ["a"]


def test_long_inputs(spark):
    rows = "| a | b |\n" * 50_000
    symbols = "-" * 200_000 + "\n"
    out = apply(spark, text.clean, [rows, symbols + "x", "\n" * 100_000 + "y"])
    assert out == [rows.strip(), "x", "y"]


def test_nfkc(spark):
    values = ["½ … Ａ ﬁ", "plain", None, "é"]
    assert apply(spark, text.nfkc, values) == [None if v is None else unicodedata.normalize("NFKC", v) for v in values]


def test_redaction(spark):
    gaz = redaction.Gazetteer(["John"], ["Smith"])
    values = ["Mail john.doe@example.com or 415-555-0198", "Contact John Smith today", "SSN 123-45-6789", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "", None]
    out = apply(spark, lambda c: redaction.redact(c, gaz), values)
    assert out == ["Mail <EMAIL_ADDRESS> or <PHONE_NUMBER>", "Contact <PERSON> today", "SSN <US_SSN>", "card <CREDIT_CARD> and 4111 1111 1111 1112", "", ""]
    only = apply(spark, lambda c: redaction.redact(c, gaz, ["PERSON"]), ["John Smith, a@b.example"])
    assert only == ["<PERSON>, a@b.example"]
    with pytest.raises(ValueError):
        redaction.redact(F.lit("x"), entities=["PLANET"])
