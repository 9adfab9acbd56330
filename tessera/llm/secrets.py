"""Operator 6: secret scans by rules and a linear-chain conditional random field.

The base rules (assign, access, hex) are matched on whole texts. The field tags tokens as B, I or O (secret begin,
inside, outside) and finds what the rules miss: secrets that are spoken of ("the passphrase is ..."), that come after
other words or none, or that have other shapes. Tokens are runs of letters, digits and `+/_-`. Candidates, which alone may
be B or I, are tokens of MIN_TOKEN or more characters with a digit or with a capital after a small letter, and those of
MIN_CUED or more soon after a cue such as a word for passwords. Every other token is O for certain and parts the chain:
Viterbi over the stretches between is Viterbi over the whole text. Features are the token's shape, the neighbouring words
and marks, and the file.

It is fitted here, on at most SAMPLE_STRETCHES stretches of candidates, with the texts around them, from about SAMPLE_DOCS
documents with the smallest hashes. Tokens that a base rule covers are secret there, all others are not; as the rules alone
would teach nothing but themselves, GENERATED sentences, half with made-up secrets of other kinds and half with names of
code, releases, files, hashes, numbers and words that look like secrets but are none, are set into sampled contexts, and in every round of the fit a share
of the tokens has its context or its shape hidden, so that either must do. Scanning is a map, without a shuffle.

Nulls: a null text counts as empty; a null doc_id stays. Rows that repeat give repeated rows; other columns are ignored
by scan() and kept by redact(). Spans are in code points, end exclusive; a span of the field never overlaps a base span.
Without any sampled row the field is fitted on the generated sentences alone.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, derive, quoted, share_of

KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # what is left of [0-9a-f]+ at 24 characters or more
MIN_TOKEN, MIN_CUED, CUE_REACH = 8, 6, 48
CUES = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential", "api key", "api_key", "apikey", "access key", "private key", "bearer", "login")
SAMPLE_DOCS, SAMPLE_STRETCHES, GENERATED = 4000, 6000, 8000
BUCKETS = 1 << 14
EPOCHS, RATE, PENALTY, HIDDEN = 6, 0.3, 1e-4, 0.25
O, B, I = 0, 1, 2  # noqa: E741
_DIGITS = re.compile(r"[0-9]+")
_HUMP = re.compile(r"[a-z][A-Z]")
_CUE = re.compile("|".join(map(re.escape, CUES)))
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+")
_TOKEN_OR_WORD = re.compile(r"[+/_-]|\w")
_BODY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_WORD = re.compile(r"[^\W_]+")
_SMALL = {c: c + 32 for c in range(65, 91)}
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
REDACTED = "[REDACTED]"
Span = tuple[int, int, int]


def lowered(text: str) -> str:
    """text in small letters, with as many characters as it has: where a capital becomes two, only A-Z change."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_SMALL)


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base rules, by start and kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """The tokens that may be secret, in order; found from their digits, capitals and cues, so prose costs a few scans."""
    found: set[tuple[int, int]] = set()
    for mark in (_DIGITS, _HUMP):
        end = 0
        for m in mark.finditer(text):
            if m.start() < end:
                continue
            a, b = m.start(), m.end()
            while a > end and text[a - 1] in _BODY:
                a -= 1
            while b < len(text) and text[b] in _BODY:
                b += 1
            end = b
            if b - a >= MIN_TOKEN:
                found.add((a, b))
    low = lowered(text)
    if any(c in low for c in CUES):
        for m in _CUE.finditer(low):
            for t in _TOKEN.finditer(text, m.end(), m.end() + CUE_REACH):
                a, b = t.span()
                if a == m.end():  # the rest of the cue's own word
                    continue
                while b < len(text) and text[b] in _BODY:
                    b += 1
                if b - a >= MIN_CUED:
                    found.add((a, b))
    return sorted(found)


def stretches(text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Candidates with no other token between them: the parts of the chain that are to be decoded."""
    out: list[list[tuple[int, int]]] = []
    for t in tokens:
        if out and not _TOKEN_OR_WORD.search(text, out[-1][-1][1], t[0]):
            out[-1].append(t)
        else:
            out.append([t])
    return out


def observed(text: str, a: int, b: int, n_tokens: int, low_file: bool) -> tuple[list[int], list[int]]:
    """Hashed features of a token: those of its shape and its file, and those of its neighbours."""
    t = text[a:b]
    n = b - a
    digits = sum(c.isdigit() for c in t)
    upper = sum(c.isupper() for c in t)
    counts = [t.count(c) / n for c in set(t)]
    entropy = -sum(p * math.log2(p) for p in counts)
    shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
    turns = sum(x != y for x, y in zip(shape[:-1], shape[1:]))
    before, after = text[max(0, a - 60) : a], text[b : b + 40]
    words = [w.lower() for w in _WORD.findall(before)]
    gap = re.sub(r"\s+", " ", re.split(r"[^\W_]", before)[-1][-4:])
    nxt = _WORD.search(after)
    cue = max((before.lower().rfind(c) + len(c) for c in CUES if c in before.lower()), default=0)
    near = len(_WORD.findall(before[cue:])) if cue else 9
    low_after = after.lower()
    ahead = min((low_after.find(c) for c in CUES if c in low_after), default=-1)
    # Where the nearest cue stands: so many words before, a few after, or nowhere.
    cued = f"b{near}" if near < 6 else f"a{len(_WORD.findall(after[:ahead]))}" if ahead >= 0 else "no"
    parts = _PARTS.findall(t)
    wordy = [p for p in parts if len(p) > 2 and p.isalpha() and 0.2 <= sum(c in "aeiouyAEIOUY" for c in p) / len(p) <= 0.7]
    share = sum(map(len, wordy)) / n
    letters = [c for c in t.lower() if c.isalpha()]
    vowels = sum(c in "aeiouy" for c in letters) / max(1, len(letters))
    harsh = max((len(x) for x in re.findall("[b-df-hj-np-tv-xz]+", t.lower())), default=0)
    kind = f"{int(3 * share)}:{digits > 0}:{min(len(parts), 4)}:{int(3 * upper / n)}"
    own = [
        f"wordy{int(5 * share)}", f"parts{min(len(parts), 9)}:{int(3 * share)}", f"vowel{int(8 * vowels)}", f"harsh{min(harsh, 8)}", f"uuid{bool(_UUID.fullmatch(t))}", f"mean{int(len(letters) / max(1, len([p for p in parts if p.isalpha()])))}",
        f"len{min(n, 48) // 4}", f"hex{all(c in '0123456789abcdef' for c in t)}", f"num{digits == n}", f"dig{10 * digits // n}", f"up{10 * upper // n}",
        f"ent{int(entropy * 2)}", f"turns{10 * turns // n}", f"mark{sum(c in '+/_-' for c in t)}", f"akia{t.startswith('AKIA')}", f"head{shape[:4]}", f"tail{shape[-3:]}", f"start{t[:3].lower()}",
        f"runs{len(re.findall('[a-z]{4,}', t))}", f"many{min(n_tokens, 8)}", f"file{low_file}", f"lenent{min(n, 48) // 8}:{int(entropy)}", f"lendig{min(n, 48) // 8}:{5 * digits // n}:{5 * upper // n}",
    ]
    beside = [
        f"gap{gap}", f"key{bool(words) and words[-1] in KEYWORDS}", f"prev{words[-1] if words else ''}", f"prev2{words[-2] if len(words) > 1 else ''}", f"prev3{words[-3] if len(words) > 2 else ''}",
        f"next{nxt[0].lower() if nxt else ''}", f"cue{cued}", f"cued{cued[0]}", f"eq{'=' in gap or ':' in gap}", f"cueshape{cued[0]}:{10 * turns // n}:{digits > 0}", f"cuekind{cued[0]}:{kind}", f"after{after[:1]}", f"cuewordy{cued[0]}:{int(5 * share)}:{min(harsh, 5)}", f"cuevowel{cued[0]}:{int(8 * vowels)}",
    ]
    number = lambda feats: [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in feats]
    return number(["bias", *own]), number(beside)


def sequences(text: str) -> list[tuple[list[tuple[int, int]], list[tuple[list[int], list[int]]]]]:
    tokens = candidates(text)
    if not tokens:
        return []
    low_file = any(k in text.lower() for k in KEYWORDS)
    return [(s, [observed(text, a, b, len(tokens), low_file) for a, b in s]) for s in stretches(text, tokens)]


class Field:
    """weights[feature, tag] and moves[tag, tag]; before and after a stretch all is O; I cannot follow O."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((BUCKETS, 3)) if weights is None else weights
        self.moves = np.zeros((3, 3)) if moves is None else moves
        self.moves[O, I] = -1e9

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum(0) for f in feats])

    def tags(self, feats: list[tuple[list[int], list[int]]]) -> list[int]:
        return self.viterbi([own + beside for own, beside in feats])

    def viterbi(self, feats: list[list[int]]) -> list[int]:
        e = self.scores(feats)
        best, back = self.moves[O] + e[0], []
        for x in e[1:]:
            steps = best[:, None] + self.moves
            back.append(steps.argmax(0))
            best = steps.max(0) + x
        tags = [int((best + self.moves[:, O]).argmax())]
        for k in reversed(back):
            tags.append(int(k[tags[-1]]))
        return tags[::-1]

    def step(self, feats: list[list[int]], gold: list[int], rate: float) -> None:
        """One step up the log-likelihood, by forward and backward sums."""
        e, n = self.scores(feats), len(feats)
        add = lambda x, axis: (m := x.max(axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))
        f, b = [self.moves[O] + e[0]], [self.moves[:, O]]
        for k in range(1, n):
            f.append(add(f[-1][:, None] + self.moves, 0) + e[k])
            b.append(add(self.moves + (e[n - k] + b[-1])[None, :], 1))
        b.reverse()
        z = add(f[-1] + self.moves[:, O], 0)
        for k in range(n):
            d = -np.exp(f[k] + b[k] - z)
            d[gold[k]] += 1
            self.weights[feats[k]] += rate * (d - PENALTY * self.weights[feats[k]])
        for k in range(1, n):
            d = -np.exp(f[k - 1][:, None] + self.moves + (e[k] + b[k])[None, :] - z)
            d[gold[k - 1], gold[k]] += 1
            d[O, I] = 0
            self.moves += rate * d


_SYLLABLES = [c + v for c in "b c d f g h l m n p r s t v w".split() for v in "aeiou"]


def word_like(r: random.Random, lo: int = 1, hi: int = 4) -> str:
    """A word that can be spoken, of no language."""
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randrange(lo, hi))) + r.choice(["", "n", "r", "s", "st"])


def made_up(r: random.Random) -> tuple[str, bool]:
    """A secret of a kind that the base rules do not know by itself, and whether its shape alone tells it: others share its shape else."""
    pick = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randrange(lo, hi)))
    mixed, letters = string.ascii_letters + string.digits, string.ascii_letters
    word = lambda: r.choice([word_like(r, 2, 4), r.choice(["river", "stone", "cloud", "maple", "tiger", "orange", "silver", "winter", "dragon", "market"])])
    kinds = [
        lambda: (pick(mixed, 14, 28), True),
        lambda: (pick(mixed, 8, 14), False),
        lambda: (pick(letters, 10, 18), False),
        lambda: (pick(string.ascii_lowercase, 8, 15), False),
        lambda: (f"{word().capitalize()}{r.choice('-_')}{word()}{r.choice('-_')}{r.randrange(10, 9999)}", False),
        lambda: (f"{word()}{word().capitalize()}{r.randrange(10, 999)}", False),
        lambda: (pick(mixed + "+/", 28, 56), True),
        lambda: (pick("0123456789ABCDEF", 24, 48), False),
        lambda: (f"{pick(letters, 2, 6).lower()}_{pick(letters, 3, 5).lower()}_{pick(mixed, 16, 36)}", True),
        lambda: (f"{pick(letters, 3, 6).lower()}{r.choice('-_')}{pick(mixed, 18, 40)}", True),
        lambda: (f"eyJ{pick(mixed + '_-', 24, 48)}", True),
    ]
    return r.choice(kinds)()


def harmless(r: random.Random) -> str:
    """A token with digits, marks or capitals that is none: names of code, releases, files, hashes and numbers."""
    pick = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randrange(lo, hi)))
    n = lambda k: pick(string.digits, k, k + 1)
    word = lambda: r.choice([word_like(r), r.choice("get set user name value list order item load page text main street park hotel data from request level view open client server time parse build index test http url byte string buffer node tree option error util block script".split())])
    cap = lambda: word().capitalize()
    acronym = lambda: pick(string.ascii_uppercase, 2, 5)
    hexa = r.choice(["0123456789abcdef", "0123456789ABCDEF"])
    some = lambda lo, hi, mark, make: mark.join(make() for _ in range(r.randrange(lo, hi)))
    kinds = [
        lambda: some(2, 5, "", cap) + r.choice(["", n(1), n(2)]),
        lambda: word() + some(1, 5, "", cap) + r.choice(["", "", n(1), n(2), n(3)]),
        lambda: acronym() + some(1, 4, "", cap) + r.choice(["", n(1) + cap(), n(2)]),
        lambda: some(1, 3, "", cap) + acronym() + some(1, 3, "", cap) + r.choice(["", n(1), n(1) + cap()]),
        lambda: cap()[:2] + some(1, 3, "", cap),
        lambda: some(2, 5, "_", word) + r.choice(["", f"_{n(1)}", f"_{n(4)}", n(2)]),
        lambda: some(2, 5, "-", word) + r.choice(["", f"-v{n(1)}", f"-{n(3)}", f"-{n(2)}-{word()}"]),
        lambda: f"{word()}-v{n(1)}-{n(r.randrange(1, 5))}-{r.choice(['amd64', 'x86', 'arm64', 'beta' + n(1), 'rc' + n(1), word()])}",
        lambda: "-".join(pick(hexa, k, k + 1) for k in (8, 4, 4, 4, 12)),
        lambda: pick(hexa.upper(), 40, 41),
        lambda: pick(hexa, 7, 13),
        lambda: pick(hexa.upper(), 32, 33),
        lambda: f"{acronym()}-{n(r.randrange(2, 9))}",
        lambda: f"{n(4)}-{n(2)}-{n(2)}{r.choice(['', 'T' + n(2)])}",
        lambda: n(r.randrange(8, 20)),
        lambda: "-".join(n(r.randrange(1, 7)) for _ in range(r.randrange(2, 6))),
        lambda: some(2, 5, "/", word) + f"/{word()}{n(r.randrange(1, 4))}",
        lambda: f"{word()}{n(r.randrange(2, 7))}",
        lambda: f"+{n(2)}-{n(3)}-{n(7)}",
    ]
    return r.choice(kinds)()


def sentence(r: random.Random, secret: bool) -> tuple[str, bool]:
    """A made-up sentence, with a secret, marked off by two NUL characters, or with something that only looks like one; and whether shapes alone tell."""
    cue = r.choice(["password", "passphrase", "passcode", "pwd", "login", "credential", "access key", "api key", "token", "secret", "private key"])
    some = lambda lo, hi: " ".join(word_like(r) for _ in range(r.randrange(lo, hi)))
    if secret:
        made, evident = made_up(r)
        s = f"\0{made}\0"
        cued = [f"the {cue} is {s}", f"{cue} {s}", f"use {s} as the {cue}", f"my {cue} was {s} until today", f"{cue} is now {s} {some(1, 3)}", f"your new {cue} {s} was set", f"the {cue} {some(1, 3)} is {s}", f"Authorization Bearer {s}", f"pwd={s}", f"{cue}: {s}", f"login with {s}", f"log in as {word_like(r)} with {cue} {s}"]
        alone = [f"postgres://user:{s}@host/db", f"key {s}", f"{s}", f"export {s}", f"header {s} sent", f"{some(1, 3)} {s} {some(1, 3)}"]
        said = [f"the {cue} is {s}", f"my {cue} was {s} until today", f"{cue} is now {s} {some(1, 3)}", f"the {cue} {some(1, 3)} is {s}", f"{cue}: {s}", f"pwd={s}"]
        return r.choice(cued + alone if evident else said if made.isalpha() and made.islower() else cued), evident
    junk = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(6, 13)))
    words = ["required", "incorrect", "forgotten", "protected", "invalid", "changed yesterday", "important", "necessary", "different", "something personal", "expired today", "too short", some(1, 3), some(1, 3)]
    own = harmless(r)
    near = [f"the {cue} is {r.choice(words)}", f"a {cue} {r.choice(words)} for everyone", f"forgot your {cue} yesterday {junk()}", f"the {cue} of {r.choice(words)}", f"a {cue} {junk()} {junk()} {some(1, 2)}", f"the {cue} {r.choice(words)} {junk()}, {junk()}", f"the {cue} {r.choice(words[:9])} {own} {junk()}"]
    around = [f"the {own} function", f"see {own}", f"{some(1, 3)} {own} {some(1, 3)}", f"commit {own} of {some(1, 2)}", f"version {own} released", f"file {own} saved", f"call {own} now", f"visit {own}", f"row {own}", f"we went to {own} on a {some(1, 2)}", f"{own} returns {some(1, 2)}", f"id {own}", f"order {own} shipped", own]
    return r.choice(near if r.random() < 0.25 else around), True


def planted(r: random.Random, context: str, secret: bool) -> tuple[str, list[tuple[int, int]], bool]:
    """A context with a made-up sentence between two of its words, the spans that are secret, and whether shapes alone tell."""
    words = context.split(" ")
    k = r.randrange(len(words) + 1)
    made, evident = sentence(r, secret)
    text = " ".join([*words[:k], made, *words[k:]])
    cuts = [m.start() for m in re.finditer("\0", text)]
    spans = [(a - 2 * i, b - 2 * i - 1) for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
    return text.replace("\0", ""), spans, evident


def golden(text: str, more: list[tuple[int, int]], evident: bool) -> Iterator[tuple[list, list[int], bool]]:
    """The features and the tags of a text's stretches, and whether shapes alone tell: secret is what a base rule covers, and the spans given."""
    spans = [s[:2] for s in base_spans(text)] + more
    for tokens, feats in sequences(text):
        tags, last = [], None
        for a, b in tokens:
            own = next((s for s in spans if s[0] < b and a < s[1]), None)
            tags.append(O if own is None else I if own == last else B)
            last = own
        yield feats, tags, evident or not any(tags)


def fit(texts: list[str], seed: int = 5) -> Field:
    """Texts tag themselves by the base rules; made-up sentences in their words add what the rules do not see.

    In each round a share of the stretches has its shapes hidden, and of those whose shapes alone tell a share its contexts."""
    r = random.Random(seed)
    texts = [t.replace("\0", " ") for t in texts]
    rows = [x for t in texts for x in golden(t, [], False)]
    for k in range(GENERATED):
        context = r.choice(texts)[:400] if texts and r.random() < 0.9 else ""
        rows += golden(*planted(r, context, k % 2 == 0))
    field = Field()
    rng = np.random.default_rng(seed)
    for k in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            feats, tags, evident = rows[i]
            hide = rng.random()
            no_shape, no_context = hide < HIDDEN, evident and HIDDEN <= hide < 2 * HIDDEN
            field.step([own[:1] + beside if no_shape and any(tags) else own if no_context else own + beside for own, beside in feats], tags, RATE / (1 + k))
    return field


def all_spans(text: str, field: Field) -> list[Span]:
    base = base_spans(text)
    more: list[Span] = []
    for tokens, feats in sequences(text):
        for (a, b), tag in zip(tokens, field.tags(feats)):
            if tag == B:
                more.append((a, b, 3))
            elif tag == I:
                more[-1] = (more[-1][0], b, 3)
    # Both lists are in order of their starts: one sweep finds what a base span covers.
    out, at, reach = [], 0, -1
    for s in more:
        while at < len(base) and base[at][0] < s[1]:
            reach = max(reach, base[at][1])
            at += 1
        if s[0] >= reach:
            out.append(s)
    return sorted(base + out, key=lambda s: (s[0], s[2]))


def measured(field: Field, contexts: list[str], n: int = 1000, seed: int = 99) -> tuple[float, float]:
    """Precision and recall of the field alone, by tokens, on n made-up sentences in contexts that it was not fitted on; base spans do not count."""
    r = random.Random(seed)
    right = found = there = 0
    for k in range(n):
        text, spans, _ = planted(r, r.choice(contexts) if contexts else "", k % 2 == 0)
        base = base_spans(text)
        own = {(a, b) for a, b in spans if not any(s[0] < b and a < s[1] for s in base)}
        got = {s[:2] for s in all_spans(text, field) if s[2] == 3}
        right += sum(any(a < y and x < b for x, y in own) for a, b in got)
        there += len(own)
        found += len(got)
    return right / max(1, found), right / max(1, there)


def learn(docs: DataFrame) -> Field:
    """Fits on the bounded sample, which alone is collected: the texts around candidate tokens of a share of the documents."""
    n = docs.count()
    sample = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h")).where(share_of(F.col("h"), SAMPLE_DOCS / max(1, n)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the neighbourhoods of candidate tokens are learned from, so only those travel.
        for x in batches:
            parts = [text[max(0, s[0][0] - 60) : s[-1][1] + 40] for text in x.column(0).to_pylist() for s in stretches(text, candidates(text))]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], ["part"])

    got = arrow_map(sample.select("text"), cut, "part string").orderBy(F.xxhash64("part"), "part").limit(SAMPLE_STRETCHES).collect()
    return fit(sorted({r["part"] for r in got}))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf), a row for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(field or learn(docs))

    def make(texts: list[str | None]) -> dict:
        spans = [all_spans(t or "", model.value) for t in texts]
        n = np.array([[sum(s[2] == k for s in own) for k in range(4)] for own in spans], np.int64).reshape(-1, 4)
        return {f"n_{k}": n[:, i] for i, k in enumerate(KINDS)} | {"base_sha256": [hashlib.sha256(joined([s for s in own if s[2] < 3]).encode()).hexdigest() for own in spans], "spans": [joined(own) for own in spans]}

    return derive(docs, ["doc_id"], "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long", make)


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if b > at:
            out += [text[at : max(a, at)], REDACTED if a >= at else ""]
            at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span replaced by a mark; n_chars, where there is one, is set anew. No document goes."""
    model = docs.sparkSession.sparkContext.broadcast(field or learn(docs))
    out = derive(docs, docs.columns, "text string", lambda texts: {"text": [t if t is None else redacted(t, all_spans(t, model.value)) for t in texts]}).select(*map(quoted, docs.columns))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out
