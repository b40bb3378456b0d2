"""Personal data by candidate gradient boosting, in Spark SQL functions only.

Generators with high recall propose spans, which may overlap. A span's format and what stands
around it make its features; boosted trees, fitted here to a seeded set of synthetic spans, score
it; a threshold for each kind, set on held-out synthetic spans, selects it. The trees become CASE
expressions, so a document never leaves the JVM. Four base kinds are found by format alone.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in order and their patterns (fixed values). Possessive quantifiers match the same spans
#: without recursion; the look-behinds skip starts inside a run, which can't begin a leftmost match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "text LIKE '%@%'", "ip": "digits", "card": "digits", "phone": "text LIKE '%+%' AND digits"}
VALID = {
    "email": "true",
    "ip": r"hit RLIKE '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'",
    "card": "luhn",
    "phone": "length(regexp_replace(hit, '[^0-9]', '')) BETWEEN 10 AND 15",
}
#: Candidate generators of the method, by kind. None has an upper bound: how long a match is is for the trees to judge.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}",
    "number": r"(?<![0-9+])(?:\([0-9]{2,4}\)[\x20-]?)?[0-9](?:[\x20./-]?[0-9]){6,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,}+",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?i:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?i:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
}
CANDIDATE_NEEDS = {"secret": "text RLIKE '[A-Za-z0-9_+/-]{16}'", "number": "digits", "account": "digits", "contact": "text RLIKE '(?i)dot'"}
KINDS = (*BASE, *CANDIDATES)
#: Words before a span that tell what it is, by what they tell; they end at most CONTEXT characters before it.
CONTEXT = 24
WORDS = {
    "says_secret": r"(?i)(?:token|secret|passw|passwd|pwd|api.?key|apikey|bearer|auth|credential|private.?key)",
    "says_phone": r"(?i)(?:phone|tel|call|fax|mobile|handy|whatsapp|sms)",
    "says_id": r"(?i)(?:ssn|social.?sec|passport|tax.?id|iban|account|konto|cuenta|compte|licen[cs]e no|national id|card|visa)",
    "says_other": r"(?i)(?:isbn|issn|order|invoice|commit|sha|build|version|part|model|page|year|article|doi|rev|md5|http|www)",
}

#: Ends of domain names.
DOMAINS = "(?i)(?<![a-z])(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|co|ch|at|nl|us|dev|me)$"

#: Features: SQL over hit, before and after, and the same in Python for the synthetic spans.
FEATURES = {
    "digits": ("length(regexp_replace(hit, '[^0-9]', ''))", lambda h, b, a: len(re.sub("[^0-9]", "", h))),
    "letters": ("length(regexp_replace(hit, '[^A-Za-z]', ''))", lambda h, b, a: len(re.sub("[^A-Za-z]", "", h))),
    "size": ("length(hit)", lambda h, b, a: len(h)),
    "marks": ("length(regexp_replace(hit, '[A-Za-z0-9]', ''))", lambda h, b, a: len(re.sub("[A-Za-z0-9]", "", h))),
    "switches": ("size(regexp_extract_all(hit, '[A-Za-z][0-9]|[0-9][A-Za-z]', 0))", lambda h, b, a: len(re.findall("[A-Za-z][0-9]|[0-9][A-Za-z]", h))),
    "upper": ("length(regexp_replace(hit, '[^A-Z]', ''))", lambda h, b, a: len(re.sub("[^A-Z]", "", h))),
    "three_two_four": ("int(hit RLIKE '^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$')", lambda h, b, a: int(bool(re.search("^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$", h)))),
    "phone_groups": ("int(hit RLIKE '^(?:.[0-9]{2,4}.[ -]?|[0-9]{3}[-. /])[0-9]{3}[-. ]?[0-9]{4}$')", lambda h, b, a: int(bool(re.search("^(?:.[0-9]{2,4}.[ -]?|[0-9]{3}[-. /])[0-9]{3}[-. ]?[0-9]{4}$", h)))),
    "date": ("int(hit RLIKE '^(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2})')", lambda h, b, a: int(bool(re.search("^(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2})", h)))),
    "zero_first": ("int(hit RLIKE '^0')", lambda h, b, a: int(h[0] == "0")),
    "hexa": ("int(hit RLIKE '^[0-9a-fA-F]+$')", lambda h, b, a: int(bool(re.search("^[0-9a-fA-F]+$", h)))),
    "words": ("size(regexp_extract_all(hit, '[a-z]{4,}', 0))", lambda h, b, a: len(re.findall("[a-z]{4,}", h))),
    "known_start": ("int(hit RLIKE '^(?:AKIA|ASIA|AIza|eyJ|gh[opsu]_|github_pat_|glpat-|[rsp]k[_-]|xox[abprs]-|hf_|npm_)')", lambda h, b, a: int(bool(re.search("^(?:AKIA|ASIA|AIza|eyJ|gh[opsu]_|github_pat_|glpat-|[rsp]k[_-]|xox[abprs]-|hf_|npm_)", h)))),
    "domain_end": (f"int(hit RLIKE '{DOMAINS}')", lambda h, b, a: int(bool(re.search(DOMAINS, h)))),
    "assigned": ("int(before RLIKE '[=:] ?.?$')", lambda h, b, a: int(bool(re.search("[=:] ?.?$", b)))),
    "glued": ("int(before RLIKE '[A-Za-z0-9_/.]$' OR after RLIKE '^[A-Za-z0-9_/]')", lambda h, b, a: int(bool(re.search("[A-Za-z0-9_/.]$", b) or re.search("^[A-Za-z0-9_/]", a)))),
} | {k: (f"int(before RLIKE '{v}')", lambda h, b, a, v=v: int(bool(re.search(v, b)))) for k, v in WORDS.items()}

#: Settings of the boosted trees: rounds, depth, step, and the least share of right spans among held-out ones above a threshold.
ROUNDS, DEPTH, STEP, PRECISION, SEED = 24, 3, 0.4, 0.98, 11


def synthetic(n: int = 800, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(kind, hit, before, after, 1 if personal) examples, n of each kind; the tests have examples made by other rules."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, num, low, up = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: some("aeiou" + low, r.randint(3, 9))
    plain = lambda: f"{word()} {word()} "
    cased = lambda s: s.upper() if r.random() < 0.15 else s.capitalize() if r.random() < 0.2 else s
    end = lambda *more: r.choice([" ", ".", ",", "", *more])
    out = []
    for _ in range(n):
        if r.random() < 0.5:
            known = r.random() < 0.3
            says = "" if known and r.random() < 0.5 else cased(r.choice(["token", "api_key", "secret", "password", "apikey", "auth", "bearer", "access_token", "credential", "private key", "client secret", "pwd"])) + r.choice([' = "', ": ", "=", " = '", " ", '": "', " is "])
            start = r.choice(["AKIA", "ghp_", "sk_live_", "sk-", "xoxb-", "AIza", "eyJ", "glpat-", "github_pat_", "hf_"]) if known else ""
            hit = cased(some(hexa, r.choice([16, 24, 32, 40, 64]))) if not known and r.random() < 0.4 else start + some(low + up + num + r.choice(["", "_-", "+/"]), r.randint(18, 60))
            out.append(("secret", hit, plain() + says, end('"', "'", ";"), 1))
        else:
            hit = [f"{word()}-{word()}-{some(num, 4)}-{word()}", some(hexa, 40), some(num, r.randint(16, 30)), f"{word()}{word()}_{word()}{some(num, 2)}", f"{word()}/{word()}/{some(num, 5)}{word()}", word() + word() + word(), "-" * r.randint(16, 40), "_" * r.randint(16, 40), f"{word()}-{word()}-{word()}-{word()}", f"{word()}_{word()}_{word()}"][r.randint(0, 9)]
            hit += "" if len(hit) >= 16 else some(low, 16 - len(hit))
            hit = hit.upper() if r.random() < 0.3 else hit
            out.append(("secret", hit, plain() + r.choice(["", "", "commit ", "sha ", "order ", "http://www.", "model ", "build ", "/", "page ", "sha256:", "rev "]), end("/"), 0))
        if r.random() < 0.5:
            three = lambda k: some(num, k)
            kind = r.randint(0, 4)
            hit = [f"({three(3)}){r.choice([' ', '-', ''])}{three(3)}-{three(4)}", r.choice("-. /").join((three(3), three(3), three(4))), f"{three(3)}-{three(2)}-{three(4)}", f"0{three(2)}{r.choice(' -/')}{three(r.randint(6, 8))}", f"0{three(2)} {three(4)} {three(4)}"][kind]
            says = r.choice(["phone ", "call ", "tel: ", "mobile ", "fax ", "Phone: ", "Tel. ", "whatsapp "]) if kind != 2 else r.choice(["ssn ", "SSN: ", "social security ", "SSN #"])
            out.append(("number", hit, plain() + (says if kind > 2 or r.random() < 0.6 else ""), end(), 1))
        else:
            hit = [f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1900, 2030)} {r.randint(1900, 2030)}", some(num, r.randint(7, 40)), f"978-{some(num, 1)}-{some(num, 4)}-{some(num, 4)}-{some(num, 1)}", f"{some(num, 2)}.{some(num, 3)}.{some(num, 3)}", " ".join(some(num, r.randint(1, 3)) for _ in range(r.randint(5, 12))), f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}", some(num, r.randint(8, 14))][r.randint(0, 7)]
            out.append(("number", hit, plain() + r.choice(["", "", "isbn ", "order ", "invoice ", "year ", "page ", "version ", "pi 3.", "of ", "id ", "no. ", "ref: "]), end("x"), 0))
        if r.random() < 0.5:
            groups = [some(num if r.random() < 0.7 else num + up, 4) for _ in range(r.randint(3, 6))] + [some(num, r.randint(1, 4))] * r.randint(0, 1)
            iban = r.choice(["DE", "FR", "ES", "GB", "IT", "NL", "CH", "AT", "BE", "PL"]) + some(num, 2) + " " + " ".join(groups)
            out.append(("account", iban if r.random() < 0.7 else iban.replace(" ", ""), plain() + r.choice(["", "", "IBAN ", "account ", "Konto: ", "cuenta ", "IBAN: "]), end(), 1))
        else:
            code = some("ABCDEFGHKLMN", 2) + some(num, 2) + r.choice([" ABCD EFGH IJKL MNOP", some("ABCDEFGHKLMN0123", r.randint(8, 14)), " THE ANDS INTO HERE", some(up, r.randint(8, 20)), " " + " ".join(some(up, r.randint(2, 4)) for _ in range(r.randint(4, 12)))])
            out.append(("account", code, plain() + r.choice(["", "model ", "part ", "order "]), end("-"), 0))
        if r.random() < 0.5:
            at, dot = r.choice([("[at]", "[dot]"), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" AT ", " DOT "), ("{at}", "{dot}")])
            hit = r.choice([word(), f"{word()}.{word()}", f"{word()}{some(num, 2)}"]) + at + word() + dot + r.choice(["com", "org", "net", "de", "edu", "co", "io", "uk", "fr", "es"])
            out.append(("contact", hit if r.random() < 0.9 else hit + dot + "uk", plain() + r.choice(["", "mail ", "contact: ", "write to ", "e-mail "]), end(), 1))
        else:
            after = r.choice(["and", "or", "the", "in", word(), word() + word()])
            out.append(("contact", word() + r.choice([" at ", " At "]) + r.choice(["the", "a", word()]) + " dot " + (after if not re.search(DOMAINS, after) else "on"), plain() + r.choice(["", "he ", "look ", "he is ", "page "]), " ", 0))
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients g and curvatures h: (feature, limit, tree if below, tree if not) or a value."""
    best = (1e-6, None)
    own = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]) if depth and len(x) >= 20 else ():
        for limit in np.unique(x[:, f])[1:]:
            low = x[:, f] < limit
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - own
            if gain > best[0] + 1e-9:
                best = (gain, (f, float(limit)))
    if best[1] is None:
        return float(-g.sum() / (h.sum() + 1))
    f, limit = best[1]
    low = x[:, f] < limit
    return f, limit, _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1)


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def features_of(hit: str, before: str, after: str) -> list[float]:
    return [f(hit, before, after) for _, f in FEATURES.values()]


def fit(examples: list[tuple] | None = None) -> dict[str, tuple[list, float]]:
    """Per kind boosted trees and the score from which a candidate is selected."""
    found = {}
    for kind in CANDIDATES:
        own = [e for e in examples or synthetic() if e[0] == kind]
        x = np.array([features_of(*e[1:4]) for e in own], float)
        y = np.array([e[4] for e in own], float)
        held = np.arange(len(y)) % 3 == 0
        score, trees = np.zeros(len(y)), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = _tree(x[~held], (p - y)[~held], (p * (1 - p))[~held], DEPTH)
            trees.append(tree)
            score += STEP * np.array([_value(tree, row) for row in x])
        # The lowest score at which held-out selections are right often enough, at least even odds; halfway down to the next score, so that no rounding decides.
        seen = np.unique(score[held])
        right = [i for i, s in enumerate(seen) if s >= 0 and y[held & (score >= s)].mean() >= PRECISION]
        found[kind] = (trees, max(0.0, float(seen[right[0]] + seen[max(0, right[0] - 1)]) / 2) if right else float("inf"))
    return found


def _case(tree) -> str:
    names = list(FEATURES)
    return repr(tree) + "D" if not isinstance(tree, tuple) else f"IF(f.{names[tree[0]]} < {tree[1]!r}D, {_case(tree[2])}, {_case(tree[3])})"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with the value, worked out once, under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Items that a scan appends to one array: appending copies it, so longer lists are scanned in pieces and stay linear.
PIECE = 256


def _scan(items: str, carry: str, first: str, step: str, emit: str, out: str) -> str:
    """SQL: `emit` of each x of items in order, as an array of type out. a.s, of type carry, begins as `first` and becomes `step` after each."""
    inner = f"""aggregate(slice(v, k * {PIECE} + 1, {PIECE}), named_struct('s', IF(k = 0, {first}, element_at(done, -1).s), 'out', CAST(array() AS array<{out}>)),
        (a, x) -> CAST(named_struct('s', {step}, 'out', concat(a.out, array({emit}))) AS struct<s:{carry},out:array<{out}>>))"""
    pieces = f"aggregate(sequence(0, (size(v) - 1) div {PIECE}), CAST(array() AS array<struct<s:{carry},out:array<{out}>>>), (done, k) -> concat(done, array({inner})))"
    return _let("v", items, f"IF(size(v) = 0, CAST(array() AS array<{out}>), flatten(transform({pieces}, p -> p.out)))")


MATCH = "struct<start:int,stop:int,hit:string,before:string,after:string>"


def _matches(pattern: str, need: str) -> str:
    """SQL: the matches of a pattern in text (start, stop, hit, before, after): their places follow from the lengths of matches and of what stands between."""
    size = "length(x.g) + length(x.h)"
    emit = f"named_struct('start', a.s + length(x.g), 'stop', a.s + {size}, 'hit', x.h, 'before', right(x.g, {CONTEXT}), 'after', left(x.n, 1))"
    items = _let("g", f"split(text, {_quoted(pattern)}, -1)", f"transform(regexp_extract_all(text, {_quoted(pattern)}, 0), (h, i) -> named_struct('g', g[i], 'h', h, 'n', g[i + 1]))")
    return f"IF({need}, {_scan(items, 'int', '0', f'a.s + {size}', emit, MATCH)}, CAST(array() AS array<{MATCH}>))"


#: Whether the digits of x.hit number 14 to 19 and pass Luhn: from the right every second one counts double, its digits added.
LUHN = """length(regexp_replace(x.hit, '[^0-9]', '')) BETWEEN 14 AND 19 AND
    aggregate(filter(split(reverse(regexp_replace(x.hit, '[^0-9]', '')), ''), c -> c <> ''), named_struct('n', 0, 'sum', 0),
        (a, c) -> named_struct('n', a.n + 1, 'sum', a.sum + IF(a.n % 2 = 0, int(c), int(c) * 2 - IF(int(c) > 4, 9, 0))), a -> a.sum % 10 = 0)"""


def find_pii(docs: DataFrame, model: dict[str, tuple[list, float]] | None = None) -> DataFrame:
    """One row per row of docs (columns doc_id, text): doc_id, base, added.

    base: the base kinds' spans, added: the method's, as arrays of (start, rank, kind, stop) in
    code points, stop exclusive, in order of start and then of kind as in KINDS. Added spans
    overlap neither base spans nor each other: read in order of start, of two that overlap the one
    with the higher score counts, the earlier one if they are equal. A null or empty text has
    none. Repeated rows give equal rows. An empty table gives none. The work on a document grows
    with its matches, not with their square.
    """
    model = model or fit()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("digits", F.expr("text RLIKE '[0-9]'"))
    out = "named_struct('start', x.start, 'rank', {rank}, 'kind', '{kind}', 'stop', x.stop)"
    parts = []
    for rank, kind in enumerate(BASE):
        test = LUHN if VALID[kind] == "luhn" else re.sub(r"\bhit\b", "x.hit", VALID[kind])
        parts.append(f"transform(filter({_matches(BASE[kind], NEEDS[kind])}, x -> {test}), x -> {out.format(rank=rank, kind=kind)})")
    scored = []
    for rank, kind in enumerate(CANDIDATES, len(BASE)):
        trees, limit = model[kind]
        if limit == float("inf"):
            continue
        features = ", ".join(f"'{n}', " + re.sub(r"\b(hit|before|after)\b", r"x.\1", sql) for n, (sql, _) in FEATURES.items())
        total = " + ".join(f"{STEP!r}D * {_case(t)}" for t in trees)
        with_f = f"transform({_matches(CANDIDATES[kind], CANDIDATE_NEEDS[kind])}, x -> named_struct('x', x, 'f', named_struct({features})))"
        with_s = f"transform({with_f}, y -> named_struct('start', y.x.start, 'added', 1, 'back', -y.x.stop, 'rank', {rank}, 'kind', '{kind}', 'stop', y.x.stop, 'score', {total.replace('f.', 'y.f.')}))"
        scored.append(f"filter({with_s}, z -> z.score >= {limit!r}D)")
    span, far = "struct<start:int,added:int,back:int,rank:int,kind:string,stop:int,score:double>", "2147483647"
    own = f"CAST(transform(base, x -> named_struct('start', x.start, 'added', 0, 'back', 0, 'rank', x.rank, 'kind', x.kind, 'stop', x.stop, 'score', 0.0D)) AS array<{span}>)"
    # Forwards, a candidate must begin where base spans have ended; backwards, end before the next one begins.
    behind = _scan(f"array_sort(concat({', '.join([own, *scored])}))", "int", "0", "IF(x.added = 0, greatest(a.s, x.stop), a.s)", "IF(x.added = 0 OR x.start >= a.s, x, NULL)", span)
    ahead = _scan(f"reverse(filter({behind}, x -> x IS NOT NULL))", "int", far, "IF(x.added = 0, x.start, a.s)", "IF(x.added = 1 AND x.stop <= a.s, x, NULL)", span)
    last = f"CAST(named_struct('start', {far}, 'added', 1, 'back', 0, 'rank', 0, 'kind', '', 'stop', {far}, 'score', 0.0D) AS {span})"
    best = _scan(f"concat(reverse(filter({ahead}, x -> x IS NOT NULL)), array({last}))", span, f"CAST(NULL AS {span})", "IF(a.s IS NULL OR x.start >= a.s.stop OR x.score > a.s.score, x, a.s)", "IF(x.start >= a.s.stop, a.s, NULL)", span)
    added = f"transform(filter({best}, x -> x IS NOT NULL), x -> named_struct('start', x.start, 'rank', x.rank, 'kind', x.kind, 'stop', x.stop))" if scored else "CAST(array() AS array<struct<start:int,rank:int,kind:string,stop:int>>)"
    found = _let("base", f"array_sort(concat({', '.join(parts)}))", f"named_struct('base', base, 'added', {added})")
    return text.select("doc_id", F.expr(found).alias("found")).select("doc_id", "found.base", "found.added")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs' doc_id and text with each span of find_pii, overlapping ones merged, replaced by its first kind in angle brackets."""
    found = find_pii(docs.select("doc_id", "text"), model).select("doc_id", F.array_sort(F.concat("base", "added")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = texts.join(found.dropDuplicates(["doc_id"]), "doc_id")
    return both.select("doc_id", F.expr("""aggregate(spans, named_struct('at', 0, 'out', ''),
        (a, s) -> IF(s.start < a.at, named_struct('at', greatest(a.at, s.stop), 'out', a.out),
            named_struct('at', s.stop, 'out', concat(a.out, substring(text, a.at + 1, s.start - a.at), '<', s.kind, '>'))),
        a -> concat(a.out, substring(text, a.at + 1)))""").alias("text"))  # fmt: skip


def pii_digest(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as kind:start:end, comma-joined), spans (all of them likewise), n_added, n_spans."""
    found = find_pii(docs, model)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
