"""Detection, masking and redaction against fixed expectations and Python's ``re``."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.functions import literals
from cloakframe.functions.detect import found, has_pii, has_type, merge_spans, pii_types, spans, types_of
from cloakframe.functions.mask import mask, redact
from cloakframe.functions.sql import lit
from cloakframe.functions.regex import java_pattern
from cloakframe.rules import DEFAULT_RULES, PATTERNS, Detection, Mask, Rules

REDACTED = [
    ("+15551234567", "************"),
    ("5551234567@example.com", "******4567***"),
    ("SSN: 123-45-6789", "SSN: ***-**-****"),
    ("Transfer to DE89370400440532013000 now", "Transfer to DE89**************3000 now"),
    ("dob 01/02/1990 ip 10.0.0.1", "dob **/**/**** ip ***.***.***.***"),
    ("4111111111111111", "************1111"),
    ("x 5551234567 john@test.com", "x ******4567 jo***@***.***"),
    ("(555) 123-4567", "**********4567"),
    ("é 555-123-4567 ☃ a@b.co", "é ********4567 ☃ a@***@***.***"),
    ("0.30000000000000004", "0.******00000000004"),
    ("1700000000", "******0000"),
    ("", ""),
    ("no pii", "no pii"),
    ("٣٤٥-٣٤-٣٤٥٦", "***-**-****"),
    (None, None),
    # the mask is shorter than the value, and the overlapping value eats what follows
    ("+123456789012345@abc.io hello", None),
]

TRICKY = [
    "é123-45-6789", "²123-45-6789", "123-45-6789²", "ⅷ10.0.0.1", "a_10.0.0.1", "é10.0.0.1", "☃10.0.0.1☃",
    "‿123-45-6789", "555\x1c123\x1d4567", "555 123\xa04567", "555　123\x854567", "555​123 4567",
    "ſmith@exampleK.com", "İstanbul@ıı.İı", "a@b.coc@d.com", "a@b.co_x@d.com", "a@b.co.uk@c.de",
    "x" * 500 + "@y.zz", "@@a@b.cd@@", "a@b.c1", "a@b-c.de-f.gh", "+1234567890123456", "+1٢٣", "DE٨٩37040044٠532013٠00",
    "de89370400440532013000", "12-31-1999 13-31-1999 02/30/20٢٢", "4111111111111111 5500000000000004 340000000000009",
    "6011000000000004 6500000000000002", "1.2.3.4.5.6.7.8", "256.1.1.1 01.02.003.255", "555.123.4567 1-555-123-4567",
    "+1 (555) 123 4567", "5551234567 5551234567", "1 555 1234567890", "\n555-123\n4567\n", "ı89370400440532013000",
    "K͏a@b.cd", "\x01a@b.cd 555-123-4567\x02 10.0.0.1\x01", "\x02 10.0.0.1", "\U0001F600 555-123-4567 \U0001F600 a@b.cd \U0001F600",
]


def python_spans(text):
    return sorted((text[s:e], s, e, k) for s, e, k in literals.find(text))


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_redact_expected(spark):
    got = rows(spark, [t for t, _ in REDACTED]).selectExpr("id", f"{redact('text')} AS r").orderBy("id").collect()
    for (text, want), r in zip(REDACTED, got, strict=True):
        if text is not None and want is None:
            want = literals.scrub(text)
        assert r.r == want, text


def test_spans_equal_python(spark):
    got = rows(spark, TRICKY).selectExpr("id", f"{spans('text')} AS s", f"{redact('text')} AS r")
    for r in got.collect():
        text = TRICKY[r.id]
        assert sorted((s.value, s.start, s.end, s.type) for s in r.s) == python_spans(text), ascii(text)
        assert r.r == literals.scrub(text), ascii(text)


def test_derived_patterns_equal_python(spark):
    """The generic translation finds what the hand-tuned forms find."""
    plain = Rules(detections=tuple(Detection(k, p) for k, p in PATTERNS.items()))
    got = rows(spark, TRICKY).selectExpr("id", f"{spans('text', plain)} AS s")
    for r in got.collect():
        assert sorted((s.value, s.start, s.end, s.type) for s in r.s) == python_spans(TRICKY[r.id]), ascii(TRICKY[r.id])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 2**32))
def test_random_text_equals_python(spark, seed):
    rnd = random.Random(seed)
    alphabet = "0123456789" * 3 + "--..//()+@ ab1K_é²٣́ſ\n\xa0" + "4" * 4
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(400)]
    got = rows(spark, texts).selectExpr("id", f"{spans('text')} AS s", f"{redact('text')} AS r").collect()
    for r in got:
        text = texts[r.id]
        assert sorted((s.value, s.start, s.end, s.type) for s in r.s) == python_spans(text), ascii(text)
        assert r.r == literals.scrub(text), ascii(text)


def test_documents_equal_python(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    got = docs.selectExpr("text", f"{redact('text')} AS r", f"{spans('text')} AS s").collect()
    changed = 0
    for r in got:
        assert r.r == literals.scrub(r.text)
        assert sorted((s.value, s.start, s.end, s.type) for s in r.s) == python_spans(r.text)
        changed += r.r != r.text
    assert changed == 52


def test_flags_agree_with_spans(spark):
    texts = TRICKY + [t for t, _ in REDACTED]
    cols = [f"{has_type('text', d)} AS {d.name}" for d in DEFAULT_RULES.detections]
    got = rows(spark, texts).selectExpr(
        f"{types_of(found('text'))} AS types", f"{pii_types('text')} AS listed", f"{has_pii('text')} AS any", *cols
    )
    for r in got.collect():
        assert (r.types or []) == r.listed
        assert r.listed == sorted(t for t in DEFAULT_RULES.types if r[t])
        assert r.any == bool(r.listed)


def test_span_fields_and_merge(spark):
    df = rows(spark, ["SSN: 123-45-6789", None, "   "])
    got = df.selectExpr(f"{spans('text')} AS s").collect()
    (s,) = got[0].s
    assert s.asDict() == {
        "type": "ssn", "value": "123-45-6789", "start": 5, "end": 16, "sensitivity": "critical", "default_action": "deny"
    }
    assert got[1].s == [] and got[2].s == []
    both = df.selectExpr(merge_spans(spans("text"), spans("'a@b.cd'"), "NULL") + " AS m").first().m
    assert [m.type for m in both] == ["ssn", "email"]


@pytest.mark.parametrize(
    "value, kind, want",
    [
        ("john@test.com", "email", "jo***@***.***"),
        ("555-123-4567", "phone", "********4567"),
        ("123-45-6789", "ssn", "***-**-****"),
        ("DE89370400440532013000", "iban", "DE89**************3000"),
        ("4111111111111111", "credit_card", "************1111"),
        ("10.0.0.1", "ip_address", "***.***.***.***"),
        ("01/02/1990", "date_of_birth", "**/**/****"),
        ("+4912345", "phone_international", "********"),
        ("abc", "unheard_of", "***"),
        ("123", "phone", "***"),
        ("", "phone", ""),
    ],
)
def test_mask(spark, value, kind, want):
    assert spark.range(1).selectExpr(mask(lit(value), kind)).first()[0] == want
    assert literals.mask_literal(value, DEFAULT_RULES.mask_of(kind)) == want


def test_custom_masks(spark):
    rules = DEFAULT_RULES.with_masks(
        phone=Mask(fixed_length=5, char="#"), email=Mask(keep_start=1, template="<{start}|{start}>"), ssn=Mask(2, 2, "x")
    )
    text = "555-123-4567 john@test.com 123-45-6789"
    got = spark.range(1).selectExpr(redact(lit(text), rules)).first()[0]
    assert got == "##### <j|j> 12xxxxxxx89" == literals.scrub(text, rules)


def test_merge_overlap_leaves_nothing(spark):
    texts = ["+15551234567", "5551234567@example.com x", "+123456789012345@abc.io hello", "a@b.cd 10.0.0.1"]
    got = rows(spark, texts).selectExpr("id", redact("text", overlap="merge") + " AS r").orderBy("id").collect()
    assert [r.r for r in got] == ["*" * 12, "*" * 22 + " x", "*" * 23 + " hello", "a@***@***.*** ***.***.***.***"]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("abcdefgh", min_size=1, max_size=8), st.sampled_from([
    "a.b@c.org", "555-123-4567", "123-45-6789", "192.168.0.1", "12/31/1999", "DE89370400440532013000", "4111111111111111"
])), min_size=1, max_size=6))
def test_redacted_text_is_clean(spark, parts):
    text = " ".join(w for pair in parts for w in pair)
    out = spark.range(1).selectExpr(redact(lit(text)) + " AS r").selectExpr("r", has_pii("r") + " AS p").first()
    assert not out.p, (text, out.r)


@pytest.mark.parametrize("bad", ["(?P<x>a)", "(?i)a", "(a)(?(1)b|c)"])
def test_untranslatable_patterns_are_refused(bad):
    with pytest.raises((ValueError, re.error)):
        java_pattern(bad)


def test_translation_details(spark):
    cases = [(r"[[a]b", "[b"), (r"[&&x]+", "&&x"), (r"a$", "xa\n"), (r"a\Z", "xa\n"), (r"[]x]", "]"), (r"[^]x]", "y"),
             (r"[\w.]+", "é_²."), (r"a.b", "a\rb"), (r"\Ba", "ba"), (r"[\s]", "\x1c")]
    for p, t in cases:
        want = re.search(p, t, re.IGNORECASE) is not None
        assert spark.range(1).select(F.lit(t).rlike(java_pattern(p))).first()[0] == want, (p, t)


def test_long_texts_are_redacted_whole(spark):
    rnd = random.Random(7)
    values = ["a.b@c.org", "555-123-4567", "123-45-6789", "192.168.0.1", "12/31/1999", "DE89370400440532013000",
              "+123456789012345@abc.io", "DE89370400440532013000@x.io", "4111111111111111", "5551234567@example.com"]
    words = ["lorem", "ipsum,", "dolor;", "sit", "é: amet", "\n", "x" * 60, "no!", "(so)"]
    texts = []
    for density in (0.5, 0.05, 0.002):
        parts = [rnd.choice(values) + rnd.choice(["", " ", ", ", ","]) if rnd.random() < density else rnd.choice(words) + " "
                 for _ in range(8000)]
        texts.append("".join(parts))
    texts += ["word, " * 20_000, "1" * 50_000]
    got = rows(spark, texts).selectExpr("id", redact("text") + " AS r").collect()
    for r in got:
        assert r.r == literals.scrub(texts[r.id]), r.id


def test_dense_texts_with_masks_of_other_lengths(spark):
    """Masks that shorten or lengthen overlapping values still act at the original offsets."""
    rules = DEFAULT_RULES.with_masks(
        phone=Mask(fixed_length=1), credit_card=Mask(fixed_length=30), phone_international=Mask(template="<p>"), email=Mask(template="{start}e", keep_start=1)
    )
    rnd = random.Random(11)
    parts = ["5551234567", "+15551234567", "4111111111111111", "x1@y2.cd", " ", ",", "-", "12/31/1999", "10.0.0.1", "9", "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(n)) for n in (5, 20, 80, 300, 900) for _ in range(12)]
    merged = redact("text", rules, "merge")
    for r in rows(spark, texts).selectExpr("id", redact("text", rules) + " AS r", merged + " AS m").collect():
        text = texts[r.id]
        assert r.r == literals.scrub(text, rules), ascii(text)
        hits = sorted((a, b, kind) for a, b, kind in literals.find(text, rules))
        runs: list[list] = []
        for a, b, kind in hits:
            if runs and a < runs[-1][1]:
                runs[-1] = [runs[-1][0], max(b, runs[-1][1]), None]
            else:
                runs.append([a, b, kind])
        out, at = "", 0
        for a, b, kind in runs:
            out += text[at:a] + ("*" * (b - a) if kind is None else literals.mask_literal(text[a:b], rules.mask_of(kind)))
            at = b
        assert r.m == out + text[at:], ascii(text)
