"""Secrets: the base kinds against a plain reading of their rules, and the token test."""

import random
import re
import string

from trackspark.llm import secrets

KEY = "Zx9Kq2LwV7pTn4RbYd8McH3s"
ENC = secrets.encoder(secrets.default_vocabulary())


def plain_base(text):
    """The rules as written, with the failing matches dropped after the search."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base(small):
    texts = [r["text"] for r in small.collect()]
    texts += ["PassWord = 'hunter22' token:ab api-key=abcdef APIKEY=abcdef_9 é secret: " + "f" * 23, "AKIA" + "Z" * 16 + " AKIA12", "a" * 24 + "G" + "b" * 25]
    for t in texts:
        assert secrets.base_spans(t) == plain_base(t)


def test_random_strings():
    found = lambda t: [t[a:b] for a, _, b in secrets.random_spans(t, ENC)]
    assert found(f"see {KEY}, ok") == [KEY]
    for clean in ("d" * 40, "0123456789abcdef" * 4, "123e4567-e89b-12d3-a456-426614174000", "a_long_identifier_of_words_2024", "Internationalization-And-Localization", "=" * 40, "1" * 30):
        assert not found(clean), clean


def test_random_strings_joined_to_words():
    rng = random.Random(5)
    sets = [(string.ascii_letters + string.digits, 24), (string.ascii_letters + string.digits + "+/", 32), (string.ascii_letters + string.digits + "-_", 40)]
    for before in ("production_database_connection_credential=", "/services/integration/notifications/", "https://hooks.example/services/incoming/notifications/customer-support/"):
        for letters, size in sets:
            hit = 0
            for _ in range(200):
                t = f"{before}{''.join(rng.choices(letters, k=size))} end"
                # Up to three characters at the ends may look like the path.
                hit += any(a <= len(before) + 3 and e >= len(before) + size - 3 for a, _, e in secrets.random_spans(t, ENC))
            assert hit >= 0.96 * 200, (before, size)
    found = lambda t: [t[a:b] for a, _, b in secrets.random_spans(t, ENC)]
    other = KEY[::-1]
    assert found(f"/customers/integration/{KEY}/notifications/configuration/development/{other}/information/international") == [KEY, other]
    assert found(f"production_database_connection_credential={KEY[:18]}==") == [KEY[:18] + "=="]
    for clean in ("/customers/notifications/123e4567-e89b-12d3-a456-426614174000/details", "/objects/configuration/notifications/international/" + "0a1b2c3d" * 4 + "/information/development", "/usr/lib/python3/site-packages/configuration"):
        assert not found(clean), clean


def test_one_letter_case():
    rng = random.Random(6)
    keys = [lambda n=n: "".join(rng.choices(string.ascii_lowercase, k=n)) for n in (20, 24, 40)]
    keys += [lambda: "-".join("".join(rng.choices(string.ascii_uppercase, k=5)) for _ in range(5))]
    for before in ("", "production_database_connection_credential="):
        for key in keys:
            hit = sum(bool(secrets.random_spans(f"{before}{key()} end", ENC)) for _ in range(200))
            assert hit >= 0.95 * 200, before
    for clean in ("an_id_of_a_word_to_be_kept", "MAX_CHARACTERS_PER_TOKEN_EXCLUDED", "internationalization", "donaudampfschifffahrtsgesellschaft", "RESPONSABILIDADES-ADMINISTRATIVAS"):
        assert not secrets.random_spans(clean, ENC), clean


def test_table(awkward, empty, spark):
    rows = secrets.scan_secrets(awkward).collect()
    assert len(rows) == 11 and {r["spans"] for r in rows if r["doc_id"] in (2, 3)} == {""}
    t = f"token = {KEY} {'ab' * 15}"
    df = spark.createDataFrame([(1, t, "k")], "doc_id long, text string, spans string")
    r = secrets.scan_secrets(df).first()
    assert r["spans"] == "assign:0:32,random:8:32,hex:33:63" and (r["n_assign"], r["n_access"], r["n_hex"], r["n_random"]) == (1, 0, 1, 1)
    assert secrets.redact(df).first()["text"] == "[secret] [secret]"
    assert secrets.redact(awkward).filter("text is null").count() == 1
    assert secrets.scan_secrets(empty).count() == 0 and secrets.redact(empty).count() == 0
