"""Secrets and personal data against plain-Python twins over whole tables, and planted sets with recall and precision."""

import hashlib
import random
import re

import duckdb

from quern.llm import pii, secrets

FOLDER = "/root/testdata/sf0.001"


def whole_texts():
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall()
    return dict(rows)


def base_secrets(text):
    out = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def twin_secrets(text, scope=300):
    """All parts, then every weak one is held against every other part."""
    base = base_secrets(text)
    access = r"""(?:access_?key(?:_?id)?|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
    endpoint = r"""(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?:endpoint|host(?:name)?|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}"""
    weak, at = [], 0
    while m := re.compile(access, re.I | re.A).search(text, at):
        if re.search(r"secret[_-]?$", text[: m.start()], re.I):
            at = m.start() + 1
            continue
        weak.append((m.start(), 3, "weak_access", m.end()))
        at = m.end()
    for m in re.finditer(r"[A-Za-z0-9+/_-]+={0,2}", text):
        value = m[0].rstrip("=")
        if len(value) >= 20 and re.search("[0-9]", value) and re.search("[A-Z]", value) and re.search("[a-z]", value):
            weak.append((m.start(), 4, "weak_secret", m.end()))
    weak += [(m.start(), 5, "endpoint", m.end()) for m in re.finditer(endpoint, text, re.I | re.A)]
    found = list(base)
    for w in weak:
        near = {p[2] for p in base + weak if p != w and (0 <= w[0] - p[3] <= scope or 0 <= p[0] - w[3] <= scope)}
        secret = near & {"assign", "hex", "weak_secret"}
        if w[2] == "weak_access" and secret or w[2] == "weak_secret" and ("access" in near or {"weak_access", "endpoint"} <= near) or w[2] == "endpoint" and near & {"access", "weak_access"} and secret:
            found.append(w)
    return base, sorted(found)


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def value(r, n=24):
    return "".join(r.choices("abcdefgh", k=n // 3) + r.choices("ABCDEFGH", k=n // 3) + r.choices("0123456789", k=n - 2 * (n // 3)))


def planted_credentials(n=60):
    """Texts with credentials in parts, and texts with one part alone or parts too far apart; the secret's place or None."""
    r, rows = random.Random(12), []
    filler = lambda k: " ".join("".join(r.choices("lmnopqrst", k=5)) for _ in range(k))
    for i in range(n):
        secret = value(r)
        parts = [f"user: name{i}", f"https://host{i}.example.com/path", f"the value {secret} here"]
        kind = i % 6
        if kind == 0:
            text = f"{filler(8)} " + f" {filler(5)}\n".join(r.sample(parts, 3))
        elif kind == 1:
            text = f"id {'AKIA' + 'Q7' * 8} {filler(10)} {parts[2]}"
        elif kind == 2:
            text = f"{filler(20)} {parts[2]} {filler(30)}"
        elif kind == 3:
            text = f"{parts[0]} {filler(80)} {parts[2]} {filler(80)} {parts[1]}"
        elif kind == 4:
            text = f"account: {secret} {filler(12)}"
        else:
            text = f"aws_secret_access_key = {secret} {filler(10)}"
        place = text.index(secret)
        rows.append((text, f"weak_secret:{place}:{place + len(secret)}" if kind < 2 else None))
    return rows


def test_secrets_against_a_twin(spark):
    texts = whole_texts()
    for i, (text, _) in enumerate(planted_credentials()):
        texts[10_000_000 + i] = text
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for doc, text in texts.items():
        base, found = twin_secrets(text)
        counts = tuple(sum(s[2] == k for s in base) for k in ("assign", "access", "hex"))
        assert (got[doc].n_assign, got[doc].n_access, got[doc].n_hex) == counts, doc
        assert got[doc].base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest(), doc
        assert got[doc].spans == shown(found), doc


def test_planted_credentials(spark):
    """Every secret whose complementary parts stand near is found; none alone, far from them, or confirmed by its own value."""
    rows = planted_credentials()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("weak_secret")] for r in secrets.find_secrets(docs).collect()}
    assert found == {i: [s] if s else [] for i, (_, s) in enumerate(rows)}


def test_parts_touch_and_overlap(spark):
    """Distances run from a part's end to the next one's start; parts that overlap don't complement each other."""
    key, secret = "AKIA" + "Q" * 16, "Zx9aQwErTy12UiOpAsDfGhJk"
    texts = [key + " " * 300 + secret, key + " " * 301 + secret, f"https://{secret}.example.com account=x", f"user={secret}"]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: shown(twin_secrets(t)[1]) for i, t in enumerate(texts)}
    assert "weak_secret" in got[0] and "weak" not in got[1] and got[3] == ""


def base_personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(reversed(d))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
    )
    return sorted((m.start(), i, kind, m.end()) for i, (kind, pattern, holds) in enumerate(kinds) for m in re.finditer(pattern, text) if holds(m))


def twin_candidates(text, base):
    """start, end, kind and votes of every candidate apart from the base spans."""
    shapes = {
        "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        "account": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
        "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_.@])",
    }
    out = []
    for kind, pattern in shapes.items():
        for m in re.finditer(pattern, text):
            a, b, number = m.start(), m.end(), re.sub("[^0-9]", "", m[0])
            if any(s < b and a < e for s, _, _, e in base):
                continue
            before = text[max(0, a - 40) : a].lower()
            says = lambda words: any(re.search(rf"(?<![a-z]){w}(?![a-z])", before) for w in words)
            good = {
                "national_id": not re.search("^(000|666|9)|^...00|0000$", number),
                "local_phone": bool(re.search("^[2-9]..[2-9]", number)),
                "account": 15 <= len(m[0].replace(" ", "")) <= 34 and len(number) >= 8,
                "handle": not re.search(r"(.)\1\1", m[0]),
            }[kind]
            near = any(s < b + 120 and a - 120 < e for s, _, _, e in base)
            votes = (1 if good else -1, int(says(pii.GAZETTEER[kind])), int(says(pii.PERSONAL)), -int(says(pii.IMPERSONAL)), int(near))
            out.append((a, b, kind, votes))
    return out


def twin_personal(texts):
    """Base and all spans of each text: votes and sums in plain Python, the model taught by their counts."""
    base = {d: base_personal(t) for d, t in texts.items()}
    rated = {d: twin_candidates(t, base[d]) for d, t in texts.items()}
    counts = {}
    for rows in rated.values():
        for *_, kind, votes in rows:
            counts[kind, votes] = counts.get((kind, votes), 0) + 1
    weights = pii.train(sorted((k, v, n) for (k, v), n in counts.items()))
    ranks = {k: 4 + i for i, k in enumerate(("national_id", "local_phone", "account", "handle"))}
    found = {}
    for d, rows in rated.items():
        more = []
        for a, b, kind, votes in rows:
            logit = weights["bias"] + weights[f"kind {kind}"] + sum(weights[f"{name} {v}"] for name, v in zip(pii.LABELERS, votes) if v)
            if logit >= 0:
                more.append((a, ranks[kind], kind, b))
        found[d] = sorted(base[d] + more)
    return base, found


def planted_personal(n=400):
    """Texts with ids, phones, accounts and handles, personal or not by their surroundings; the span if personal."""
    r, rows = random.Random(31), []
    filler = lambda k: " ".join("".join(r.choices("lmnopqrst", k=5)) for _ in range(k))
    d = lambda k, first="123456789": r.choice(first) + "".join(r.choices("0123456789", k=k - 1))
    for i in range(n):
        kind = r.choice(list(pii.CANDIDATES))
        personal = r.random() < 0.5
        if kind == "national_id":
            item = f"{d(3, '1234578')}-{d(2)}-{d(4)}" if personal else f"000-{d(2)}-{d(4)}"
        elif kind == "local_phone":
            item = f"{d(3, '23456789')}-{d(3, '23456789')}-{d(4)}" if personal else f"{d(3, '1')}-{d(3, '1')}-{d(4)}"
        elif kind == "account":
            item = "DE" + d(2) + "".join(f" {d(4)}" for _ in range(4)) if personal else "XK" + d(2) + " ABCD EFGH"
        else:
            item = "@" + "".join(r.sample("abcdefghijk", 7)) if personal else "@ooo" + r.choice("abc")
        words = r.choice(pii.GAZETTEER[kind]) if personal else r.choice(pii.IMPERSONAL)
        context = f"mr {words}" if personal and r.random() < 0.7 else words
        text = f"{filler(12)} {context} {item} {filler(12)}"
        place = text.index(item)
        rows.append((text, f"{kind}:{place}:{place + len(item)}" if personal else None))
    return rows


def test_personal_data_against_a_twin(spark):
    texts = whole_texts()
    for i, (text, _) in enumerate(planted_personal()):
        texts[10_000_000 + i] = text
    got = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    base, found = twin_personal(texts)
    for doc in texts:
        counts = tuple(sum(s[2] == k for s in base[doc]) for k in ("email", "ip", "card", "phone"))
        assert (got[doc].n_email, got[doc].n_ip, got[doc].n_card, got[doc].n_phone) == counts, doc
        assert got[doc].base_sha256 == hashlib.sha256(shown(base[doc]).encode()).hexdigest(), doc
        assert got[doc].spans == shown(found[doc]), doc


def test_planted_personal_data(spark):
    """The labelers' votes find personal spans and leave the others alone; no labels are given."""
    rows = planted_personal()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal(docs).collect()}
    right = sum(s is not None and got[i] == s for i, (_, s) in enumerate(rows))
    wrong = sum(s is None and got[i] != "" for i, (_, s) in enumerate(rows))
    assert right >= 0.95 * sum(s is not None for _, s in rows)
    assert right >= 0.95 * (right + wrong)
