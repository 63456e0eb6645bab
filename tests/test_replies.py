"""Replies in their own words, their classes, references of HTML, against Python's re and html."""

import hashlib
import html
import random
import re

from threadline.functions import replies as R
from threadline.functions import text as T

LONG = "I think the loop should stop earlier because the bound is not checked before it is used"


def residue(text):
    x = re.sub(r"```.*?```", " ", text or "", flags=re.S)
    x = re.sub(r"^\s*>.*$", " ", x, flags=re.M)
    x = re.sub(r"\[([^\]]*)\]\([^)]*\)", r" \1 ", x)
    for p in (r"<[^>]+>", r"https?://\S+", r"`[^`]*`", r"\s+"):
        x = re.sub(p, " ", x)
    return x.strip()


PIECES = ["```", "`", "> quoted", ">", "\n", " ", "\u00a0", "\u2003", "\x1c", "\x85", "\u2028", "\r\n", "[a b](http://c.d)", "[x](y", "<b>", "<", "https://e.f/g?h ", "http://", "word", "it's", "re-do", "é", "12", "@copilot", "@copilots", "@copilot-x", "@copiloté", "@Claude", "/retest", "a/retest", "/Cherry-Pick ", "@me", "漢"]


def samples(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_residue_as_python_reads_it(spark):
    texts = [*samples(1, 1500), "", None, LONG, f"> {LONG}\n\n \t> x\nyes", f"```py\n{LONG}\n```\nok", "a\u2028> b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", R.readable_residue("t").alias("x"), R.readable_words("t").alias("n")).collect():
        assert r.x == residue(texts[r.i]), texts[r.i]
        assert r.n == len(re.findall(r"[A-Za-z][A-Za-z'\-]*", r.x))


def test_classes_by_precedence(spark):
    invoked = re.compile(r"@(?:" + "|".join(map(re.escape, R.HANDLES)) + r")\b|(?:^|\s)/(?:" + R.COMMANDS + r")\b", re.I)
    platform = re.compile(R.PLATFORM, re.I)

    def of(t):
        t = t or ""
        if platform.search(t):
            return "platform_generated"
        if invoked.search(t):
            return "agent_invocation"
        return "acknowledgement_only" if len(re.findall(r"[A-Za-z][A-Za-z'\-]*", residue(t))) < 12 else "substantive_response"

    texts = [*samples(2, 1500), None, "", LONG, f"{LONG} @someone", f"> {LONG}", "Open a new pull request to apply changes based on this thread @copilot", "APPLY changes based on [the comments in [this thread]", "@claude-bot go", f"{LONG} /lgtm", "/lgtm_x", "1 2 3 4 5 6 7 8 9 10 11 12 13"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", R.reply_class("t").alias("k")).collect()}
    assert [got[i] for i in range(len(texts))] == [of(t) for t in texts]
    assert set(got.values()) == set(R.CLASSES)


def test_templates_and_packets(spark):
    texts = ["Build 12 of @bot-x failed: https://a.b/1 \n> q\nSEE `x`", "build 7 of @y failed: http://c.d\u00a0 see `x`", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(R.template_body("t")).collect()]
    assert got == ["build of failed: see `x`", "build of failed: see `x`", ""]
    long = " \u2003a  b\tc " + "x" * 3000 + "\r\nme@x.org\rhttps://a.b/c sk-" + "z" * 24 + " \n"
    df = spark.createDataFrame([(0, long), (1, "plain akia" + "0" * 16), (2, None)], "i int, t string")
    p = [r.p for r in df.orderBy("i").select(R.packet_text("t").alias("p")).collect()]
    whole = "a b c " + "x" * 3000 + "\n[EMAIL]\n[URL] sk-" + "z" * 24
    assert (p[0].text, p[0].digest, p[0].cut, p[0].secret) == (whole[:2500], hashlib.sha256(whole.encode()).hexdigest(), True, True)
    assert (p[1].cut, p[1].secret, p[2].text, p[2].cut, p[2].secret) == (False, True, "", False, False)


def test_unescape_as_python_reads_it(spark):
    rng = random.Random(3)
    names = list(html.entities.html5)
    texts = [f"x&{n}y &{n.rstrip(';')} z" for n in names]
    texts += [f"&#{n};&#{n} &#x{n:x};" for n in (*range(0, 300), 0x2019, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**12)]
    texts += ["", None, "&", "&&amp;&", "&notit; &ampx &amp;lt; &#; &#x; &#xg &bogus; & amp;", "a&#0000000000065;b&#x000000000041;", "&\n&\t<&amp"]
    texts += ["".join(rng.choice(["&", "#", "x", "amp", "lt", ";", "not", "in", "65", " ", "é", "Acirc"]) for _ in range(10)) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", T.unescape("t").alias("x")).collect():
        assert r.x == (None if texts[r.i] is None else html.unescape(texts[r.i])), texts[r.i]


def test_titles_fold_every_blank(spark):
    df = spark.createDataFrame([("A\u00a0\x0bb\u3000caf&eacute; https://x.y\u00a0z",)], "t string")
    assert df.select(T.normalise("t")).first()[0] == "a b café url z"
