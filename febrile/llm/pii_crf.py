"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns (e-mail, ip, card, phone) give the base spans.  The field adds
names after titles or introductions, local phone numbers, identity numbers,
spelled-out e-mail addresses and secrets (keys and tokens that are assigned).  Signs
at the edges of words are tokens of their own.  The field sees the shapes of a token and
its two neighbours and the words before and after it, past any signs (a word before a
full stop is told from the same word before other signs, so "Mr." leads on and "is." does not); it is
trained from a small labelled table, and is decoded by Viterbi in numpy over
batches of lines.

A line can only be decoded as anything but "outside" throughout if some token
gains by leaving "outside" even under the kindest transitions; lines without
such a token are settled by that bound and skip the recursion.

Defined results: a null text is empty and has no span; texts, lines and words of any
length are read whole; of equally good label sequences the one with the earlier
labels (in sorted order, "outside" first) is taken, so equal texts get equal spans; repeated rows and null
ids are handled row by row; an empty table gives an empty table; an empty
training table adds no span; other columns pass through and an input column with
the name of a result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.llm.common import read_table, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = ("name", "local_phone", "id_number", "spelled_email", "secret")
OUTSIDE = 0

EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"""\w(?:[^\s"=<>|{}\[\]()]*\w)?|[^\w\s]+""")


# ---------------------------------------------------------------- fixed patterns

def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each is anchored at its "@", so long words cost one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_LEFT.match(text, start - 1):
            start -= 1
        m = EMAIL_RIGHT.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern matches, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- the labelled table

#: The labelled lines, [kind|words] marks a span, {slot} takes each filler in turn.
LABELLED_LINES = (
    "My name is [name|{given} {family}] and I live here.",
    "my name is [name|{given} {family}]",
    "Her name is [name|{given} {family}], they said.",
    "Please ask for Mr. [name|{family}] at the desk.",
    "Dear Mrs. [name|{family}], thank you for the letter.",
    "We saw Dr. [name|{given} {family}] on Monday.",
    "Ms. [name|{given} {family}] signed the form.",
    "Signed by Prof. [name|{given} {family}] in person.",
    "Contact person: [name|{given} {family}]",
    "Name: [name|{given} {family}]",
    "Call me at [local_phone|{phone}] after nine.",
    "Phone: [local_phone|{phone}]",
    "tel. [local_phone|{phone}] or come by",
    "You can call [local_phone|{phone}] today.",
    "Her SSN is [id_number|{ssn}] on file.",
    "SSN: [id_number|{ssn}]",
    "social security number [id_number|{ssn}] was given",
    "passport no. [id_number|{passport}] expires soon",
    "Passport: [id_number|{passport}]",
    "write to [spelled_email|{given} at {host} dot com] for more",
    "mail [spelled_email|{given} (at) {host} (dot) org] please",
    "e-mail: [spelled_email|{given} [at] {host} [dot] net]",
    "The {given} team and the {family} river are old.",
    "In 2019 there were 4821 people and 315 houses.",
    "Chapter 12 on page 345 is about the {family} road.",
    "{given} was is the of and. {family} and the tion there.",
    "Thereat and onble the ing. {given} {family} the erth.",
    "the values are 12.5 and 99.1 at 20 degrees",
    "It was at the {host} dot on the map",
    "Order 20391-77 has 3 parts at 12,50 each.",
    "look at the house and the dot in the com port",
    "Erhe and on Dr in the name of this and that",
    "der die das und {family} Ist ein {given} hier.",
    "la casa de {family} es grande y el {given} no.",
    "le nom de la rue et {family} sont au {given} la.",
    "THE {given} AND THE {family} ARE HERE!! NOW!!",
    "word*** word$$$ {given}### {family}&&& the%%%",
    "the | {given} | {family} | and | 4512 | of",
    "call the function with 3 arguments and a phone case",
    "You can reach me on [local_phone|{phone}].",
    "My phone number is [local_phone|{phone}].",
    "Ring us on [local_phone|{phone}], please.",
    "our number is [local_phone|{phone}] (office)",
    "Her SSN is [id_number|{ssn}], she said.",
    "his social security number: [id_number|{ssn}].",
    "Email me at [spelled_email|{given} dot {family} at {host} dot com]",
    "reach me: [spelled_email|{given} dot {family} at {host} dot org].",
    "Signed, [name|{given} {family}]",
    "Regards, [name|{given} {family}]",
    "I am [name|{given} {family}], the manager.",
    "Hello, I am [name|{given} {irish}] from the office.",
    "my name is [name|{given} {irish}].",
    "I am here, The {family} Hotel is there.",
    "She lives in {family} Street, near the {given} Park.",
    "I met them at {family} Street on Monday.",
    "Regards to all of you",
    "they went to the la {given} {family}",
    "thering, er, To {given} {family}",
    "of 12 la {family} {given}",
    "write to [spelled_email|{host} at {host} dot com] for more",
    "mail [spelled_email|{host} at {host} dot net] please",
    "{given} {given} {given} {given} {given} {given} is.",
    'token = "[secret|{key}]" and more',
    'TOKEN = "[secret|{key}]"!!',
    "api_key: [secret|{key}]",
    "password = [secret|{key}] here",
    "the secret is [secret|{key}].",
    "export SECRET_KEY=[secret|{key}]",
    "Authorization: Bearer [secret|{key}]",
    "commit {key} was merged",
    "the file {key} has the sum {key}",
    "a token of thanks, and the key = 12",
    "+1 (017) 555-7713 and 97.51.17.173 or 4365873117289653 stand alone",
)
#: Fillers of the slots.
FILLERS = {
    "given": ("Anna", "Boris", "Clara", "David", "Elena", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Keiko", "Liam"),
    "family": ("Smith", "Okafor", "Garcia", "Nowak", "Tanaka", "Weber", "Rossi", "Dubois", "Larsen", "Khan", "Silva", "Ito"),
    "irish": ("O'Brien", "O'Casey", "D'Angelo", "O'Hara"),
    "phone": ("555-0123", "(017) 555-7713", "030 1234567", "212-555-0198", "555 0142", "(415) 555-0111", "020 7123 4567", "0171 555 0199"),
    "key": ("0f3a9be1774cd2085e6b91aa30c4d7f2e85b16c9", "d41d8cd98f00b204e9800998ecf8427e", "zX9kQ2mV7tR4bN8cW1yP5s",
            "A1B2C3D4E5F60718293A4B5C6D7E8F90", "pk-live-81hd72ksu1029dkwu2"),
    "ssn": ("123-45-6789", "987-65-4320", "219-09-9999", "457-55-5462"),
    "passport": ("C01X00T47", "X1234567", "K8813021", "PA0012345"),
    "host": ("mail", "example", "posteo", "server", "inbox", "webhost"),
}


#: Parts of made-up words for lines without personal data.
SYLLABLES = ("ta", "ren", "o", "bli", "son", "er", "the", "mi", "ka", "und", "le", "vi", "chen", "qua", "dor", "is")
SMALL_WORDS = ("is", "at", "to", "the", "of", "la", "el", "der", "no", "in", "and", "que", "call", "name", "me", "for", "with", "est")


def plain_line(k: int) -> str:
    """The k-th line of prose without personal data: made-up and small words, some capital, short sentences, plain numbers."""
    words, state = [], 7 * k + 3
    for j in range(6 + k % 9):
        state = (state * 1103515245 + 12345) % (1 << 31)
        pick = state >> 8
        word = SMALL_WORDS[pick % len(SMALL_WORDS)] if pick % 5 < 2 else "".join(
            SYLLABLES[(pick >> (4 * s)) % len(SYLLABLES)] for s in range(1 + pick % 3))
        if j == 0 or words[-1].endswith(".") or pick % 7 == 0:
            word = word.capitalize()
        if pick % 23 == 0:
            word = str(pick % 100_000)
        words.append(word + (".", "", "", ",", "", "")[(pick >> 5) % 6])
    return " ".join(words)


def labelled_table(spark: SparkSession) -> DataFrame:
    """The small labelled table: one row per line, with its tokens and their labels."""
    rows = [_tokens_and_labels(plain_line(k)) for k in range(800)]
    for k, line in enumerate(LABELLED_LINES):
        for turn in range(12):
            pick = {slot: words[(turn * (3 + n) + k) % len(words)] for n, (slot, words) in enumerate(FILLERS.items())}
            rows.append(_tokens_and_labels(re.sub(r"\{(\w+)\}", lambda m, p=pick: p[m.group(1)], line)))
    return spark.createDataFrame(rows, "tokens array<string>, labels array<string>")


def _tokens_and_labels(line: str) -> tuple[list[str], list[str]]:
    tokens, labels, at = [], [], 0
    for m in re.finditer(r"\[(\w+)\|(.*?)\](?=$|[ ,.\"])", line):
        tokens += TOKEN.findall(line[at:m.start()])
        labels += ["O"] * (len(tokens) - len(labels))
        for j, t in enumerate(TOKEN.findall(m.group(2))):
            tokens.append(t)
            labels.append(("I-" if j else "B-") + m.group(1))
        at = m.end()
    tokens += TOKEN.findall(line[at:])
    return tokens, labels + ["O"] * (len(tokens) - len(labels))


# ---------------------------------------------------------------- features and training

MIXED = re.compile(r"[A-Za-z0-9+/_.-]{16,}")


def shape(token: str) -> str:
    """Word shape: letters (and apostrophes between them), digits and signs by class, runs shortened to two; digits to four.

    Long words that mix letters and digits, whatever their order, have one shape.
    """
    if MIXED.fullmatch(token) and sum(c.isdigit() for c in token) >= 3 and sum(c.isalpha() for c in token) >= 3:
        return "mixed"
    out, last, run = [], "", 0
    for c in token:
        k = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c
        if c in "'\u2019" and last in ("x", "X"):
            k = last
        run = run + 1 if k == last else 1
        if run <= (4 if k == "d" else 2):
            out.append(k)
        last = k
    return "".join(out)


def context_word(token: str) -> str:
    return token.lower()


def word_places(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the word before and after each token of lines laid end to end, signs skipped; -1 where the line has none."""
    n, places = len(word), np.arange(len(word))
    line = np.cumsum(first)
    before, after = np.full(n, -1), np.full(n, -1)
    if n > 1:
        before[1:] = np.maximum.accumulate(np.where(word, places, -1))[:-1]
        after[:-1] = np.minimum.accumulate(np.where(word, places, n)[::-1])[::-1][1:]
    before[(before < 0) | (line[before] != line)] = -1
    after[(after >= n) | (line[np.minimum(after, n - 1)] != line)] = -1
    return before, after


@dataclass
class Field:
    """Trained weights: emission tables of a token and its neighbours (index 0: unknown), transitions, labels."""
    labels: list[str]
    index: dict[str, int]       # "s:<shape>", "w:<word>" or "e:<word before a full stop>" -> row
    tables: np.ndarray          # 3 places (before, here, after) x 2 kinds x rows x labels
    trans: np.ndarray           # label to label
    first: np.ndarray

    def rows(self, token: str) -> tuple[int, int, int, bool, bool]:
        """Shape row, word row, word row before a full stop; whether the token is a word (not signs), or a full stop."""
        word = context_word(token)
        return (self.index.get("s:" + shape(token), 0), self.index.get("w:" + word, 0), self.index.get("e:" + word, 0),
                token[0].isalnum() or token[0] == "_", token[0] in ".!?")


def word_rows(w: np.ndarray, ended: np.ndarray, word: np.ndarray, stop: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, whether there is one) of the word before and of the word after each token."""
    before, after = word_places(word, first)
    stopped = np.concatenate([[False], stop[:-1]])
    return [(np.where(stopped, ended[before], w[before]), before >= 0), (w[after], after >= 0)]


def _emissions(field: Field, s: np.ndarray, w: np.ndarray, ended: np.ndarray, word: np.ndarray, stop: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores of all labels for lines laid end to end; ``first`` marks their first tokens."""
    t = field.tables
    em = t[1, 0][s] + t[1, 1][w]
    if len(s) > 1:
        inner = ~first[1:, None]
        em[1:] += t[0, 0][s[:-1]] * inner
        em[:-1] += t[2, 0][s[1:]] * inner
        for place, (rows, there) in zip((0, 2), word_rows(w, ended, word, stop, first), strict=True):
            em += t[place, 1][rows] * there[:, None]
    em[first] += field.first
    return em


def _moved(scores: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Log of exp(scores) @ factors, row by row, without overflow."""
    top = scores.max(1, keepdims=True)
    return np.log(np.exp(scores - top) @ factors + 1e-300) + top


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (a row each) by row number."""
    return np.stack([np.bincount(rows, v, n) for v in values.T], axis=1)


def train(labelled: DataFrame, steps: int = 150, ridge: float = 0.02, max_lines: int = 20_000) -> Field | None:
    """Maximise the conditional likelihood (forward-backward in log space) by Adam steps.

    ``labelled`` (tokens, labels) is a small table by contract: more than
    ``max_lines`` lines are refused, because they are fitted in the driver.
    """
    rows = labelled.select("tokens", "labels").limit(max_lines + 1).collect()
    if len(rows) > max_lines:
        raise ValueError(f"the labelled table has more than {max_lines} lines")
    lines = sorted((list(r["tokens"]), list(r["labels"])) for r in rows if r["tokens"])
    if not lines:
        return None
    labels = ["O"] + sorted({y for _, ys in lines for y in ys} - {"O"})
    of = {y: k for k, y in enumerate(labels)}
    seen: dict[str, int] = {}
    for tokens, _ in lines:
        for t, follows in zip(tokens, [*tokens[1:], " "], strict=True):
            for name in ("s:" + shape(t), "w:" + context_word(t), *(["e:" + context_word(t)] if follows[0] in ".!?" else [])):
                seen[name] = seen.get(name, 0) + 1
    fillers = {w.lower() for words in FILLERS.values() for v in words for w in v.split()} | set(SYLLABLES) - set(SMALL_WORDS)
    names = sorted(n for n, c in seen.items() if n[0] == "s" or (c >= 3 and n[2:].replace("_", "").isalpha() and n[2:] not in fillers))
    index = {n: k + 1 for k, n in enumerate(names)}
    n_rows, n_labels = len(index) + 1, len(labels)
    field = Field(labels, index, np.zeros((3, 2, n_rows, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    longest = max(len(t) for t, _ in lines)
    s, w, ended = (np.zeros((len(lines), longest), int) for _ in range(3))
    y = np.zeros((len(lines), longest), int)
    real, word, stop = (np.zeros((len(lines), longest), bool) for _ in range(3))
    for b, (tokens, ys) in enumerate(lines):
        for k, t in enumerate(tokens):
            s[b, k], w[b, k], ended[b, k], word[b, k], stop[b, k] = field.rows(t)
            y[b, k], real[b, k] = of[ys[k]], True
    begins = np.zeros_like(real)
    begins[:, 0] = True
    near = word_rows(w.ravel(), ended.ravel(), word.ravel(), stop.ravel(), begins.ravel())
    near_words = [rows_.reshape(real.shape) for rows_, _ in near]
    near_there = [there.reshape(real.shape) & real for _, there in near]
    gold = np.eye(n_labels)[y] * real[..., None]
    both = real[:, 1:] & real[:, :-1]
    gold_trans = np.einsum("btk,btl->kl", gold[:, :-1] * both[..., None], gold[:, 1:])
    params = [field.tables, field.trans, field.first]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        t = field.tables
        em = t[1, 0][s] + t[1, 1][w]
        em[:, 1:] += t[0, 0][s[:, :-1]]
        em[:, :-1] += t[2, 0][s[:, 1:]] * real[:, 1:, None]
        for place, rows_, there in zip((0, 2), near_words, near_there, strict=True):
            em += t[place, 1][rows_] * there[..., None]
        em[:, 0] += field.first
        alpha, beta, steps_to = np.zeros_like(em), np.zeros_like(em), np.exp(field.trans)
        alpha[:, 0] = em[:, 0]
        for k in range(1, longest):
            moved = _moved(alpha[:, k - 1], steps_to) + em[:, k]
            alpha[:, k] = np.where(real[:, k, None], moved, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            moved = _moved(em[:, k + 1] + beta[:, k + 1], steps_to.T)
            beta[:, k] = np.where(real[:, k + 1, None], moved, beta[:, k + 1])
        z = _moved(alpha[:, -1], np.ones((n_labels, 1)))[:, 0]
        p = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        come, go = alpha[:, :-1], em[:, 1:] + beta[:, 1:]
        top = come.max(2, keepdims=True) + go.max(2, keepdims=True)
        share = np.where(both, np.exp(top[..., 0] - z[:, None]), 0.0)[..., None]
        come, go = np.exp(come - come.max(2, keepdims=True)) * share, np.exp(go - go.max(2, keepdims=True))
        pair = steps_to * (come.reshape(-1, n_labels).T @ go.reshape(-1, n_labels))
        d = (gold - p)
        grads = [np.zeros_like(t), gold_trans - pair, d[:, 0].sum(0)]
        for place, (ds, dd) in enumerate(((s[:, :-1], d[:, 1:]), (s, d), (s[:, 1:], d[:, :-1]))):
            good = real[:, 1:] if place != 1 else real
            grads[0][place, 0] += _sums(ds[good], dd[good], n_rows)
        for place, dw, good in ((0, near_words[0], near_there[0]), (1, w, real), (2, near_words[1], near_there[1])):
            grads[0][place, 1] += _sums(dw[good], d[good], n_rows)
        for q, g, (m, v) in zip(params, grads, moments, strict=True):
            g = g - ridge * len(lines) / 100 * q
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return field


# ---------------------------------------------------------------- decoding

def viterbi(em: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of a batch of lines, ``em`` padded to lines x longest x labels."""
    n, longest, k = em.shape
    back = np.zeros((n, longest, k), np.int8)
    best = em[:, 0].copy()
    for t in range(1, longest):
        reach = best[:, :, None] + trans
        back[:, t] = reach.argmax(1)
        moved = reach.max(1) + em[:, t]
        best = np.where((t < lengths)[:, None], moved, best)
    out = np.zeros((n, longest), np.int8)
    last = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        here = t < lengths
        out[here, t] = last[here]
        last = np.where(here, back[np.arange(n), t, last], last) if t else last
    return out


class Decoder:
    """Finds the field's spans in texts; remembers the rows of tokens met before."""

    CELLS = 2_000_000  # padded tokens of a Viterbi batch, at most

    def __init__(self, field: Field | None):
        self.field = field
        if field:
            stay = field.trans[OUTSIDE, OUTSIDE]
            others = field.trans.copy()
            #: the most that a step into or inside other labels can gain over staying outside
            into = np.maximum(others[:, 1:].max(0) - stay, 0)
            self.gain = into + max(0.0, others[1:, OUTSIDE].max() - stay)

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not self.field:
            return found
        lookup = _Rows(self.field)
        batch: list[tuple[int, int, str]] = []
        held = 0
        for k, text in enumerate(texts):
            at = 0
            for line in text.split("\n"):
                if line and not line.isspace():
                    batch.append((k, at, line))
                    held += len(line)
                at += len(line) + 1
                if held > 1_000_000:
                    self._lines(batch, lookup, found)
                    batch, held = [], 0
        self._lines(batch, lookup, found)
        return found

    def _lines(self, batch: list[tuple[int, int, str]], lookup: _Rows, found: list) -> None:
        if not batch:
            return
        field = self.field
        tokens, lengths = [], np.zeros(len(batch), int)
        for b, (_, _, line) in enumerate(batch):
            own = TOKEN.findall(line)
            lengths[b] = len(own)
            tokens += own
        packed = np.fromiter(map(lookup.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        first = np.zeros(len(tokens), bool)
        first[starts] = True
        em = _emissions(field, packed >> 42, (packed >> 22) & 0xFFFFF, (packed >> 2) & 0xFFFFF, (packed & 2) > 0, (packed & 1) > 0, first)
        lead = (em[:, 1:] + self.gain - em[:, :1]).max(1)
        open_lines = np.flatnonzero(np.maximum.reduceat(lead, starts) > 0)
        order = open_lines[np.argsort(lengths[open_lines], kind="stable")]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * lengths[order[end]] <= self.CELLS // len(field.labels):
                end += 1
            self._decode(batch, order[at:end], starts, lengths, em, found)
            at = end

    def _decode(self, batch, rows, starts, lengths, em, found) -> None:
        own = lengths[rows]
        padded = np.zeros((len(rows), own.max(), em.shape[1]))
        for b, r in enumerate(rows):
            padded[b, :own[b]] = em[starts[r]:starts[r] + own[b]]
        labels = viterbi(padded, own, self.field.trans)
        for b in np.flatnonzero(labels.any(1)):
            k, offset, line = batch[rows[b]]
            found[k] += [(kind, offset + s, offset + e) for kind, s, e in self._cut(line, labels[b, :own[b]])]

    def _cut(self, line: str, labels: np.ndarray) -> Iterator[tuple[str, int, int]]:
        places = [m.span() for m in TOKEN.finditer(line)]
        k = 0
        while k < len(labels):
            name = self.field.labels[labels[k]]
            if name == "O":
                k += 1
                continue
            end = k + 1
            while end < len(labels) and self.field.labels[labels[end]] == "I-" + name[2:]:
                end += 1
            s, e = places[k][0], places[end - 1][1]
            while e > s and line[e - 1] in ".,;:!?\"'":
                e -= 1
            if plausible(name[2:], line[s:e]):
                yield name[2:], s, e
            k = end


def plausible(kind: str, span: str) -> bool:
    """What a span of each kind must hold, whatever its context: capitals, enough digits, both spelled signs."""
    digits = sum(c.isdigit() for c in span)
    if kind == "name":
        words = span.split()
        return not digits and len(words) <= 4 and len(set(words)) == len(words) and not any(c in "@#*$%&|<>{}!?" for c in span) and all(
            w[:1].isupper() and not (len(w) > 2 and w.isupper()) for w in words)
    if kind == "local_phone":
        return 7 <= digits <= 15
    if kind == "id_number":
        return digits >= 4 and len(span) <= 24
    if kind == "secret":
        return len(span) >= 8 and digits >= 2 and not any(c.isspace() for c in span)
    low = span.lower()
    return re.search(r"\bat\b", low) is not None and re.search(r"\bdot\b", low) is not None


class _Rows(dict):
    """Token -> its shape row and word row in one number, remembered up to a limit."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, token: str) -> int:
        s, w, ended, word, stop = self.field.rows(token)
        v = s << 42 | w << 22 | ended << 2 | word << 1 | stop
        if len(self) < 300_000 and len(token) < 100:
            self[token] = v
        return v


def merged(base: list[tuple[str, int, int]], extra: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and the field's spans that touch none of them, by kind as listed, then start."""
    kinds = {k: n for n, k in enumerate(BASE_KINDS + FIELD_KINDS)}
    taken = sorted((s, e) for _, s, e in base)
    free = []
    for kind, s, e in extra:
        if not any(a < e and s < b for a, b in taken):
            free.append((kind, s, e))
    return sorted(base + free, key=lambda x: (kinds[x[0]], x[1]))


def finder(spread):
    """Column function: base and all spans of texts under the broadcast field."""
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(spread.value)
        for series in texts:
            values = series.tolist()
            rows = []
            for text, extra in zip(values, decoder.spans(values), strict=True):
                base = base_spans(text)
                rows.append((_joined(base), _joined(merged(base, extra)), *[sum(x[0] == k for x in base) for k in BASE_KINDS]))
            yield pd.DataFrame(rows, columns=["base", "spans", *[f"n_{k}" for k in BASE_KINDS]])

    return F.pandas_udf(find, "base string, spans string, n_email long, n_ip long, n_card long, n_phone long")


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone (base matches), base_spans and spans to ``docs``; no shuffle."""
    spark = docs.sparkSession
    field = train(labelled if labelled is not None else labelled_table(spark))
    spread = spark.sparkContext.broadcast(field)  # a few hundred rows of weights
    counts = [f"n_{k}" for k in BASE_KINDS]
    added = [*counts, "base_spans", "spans"]
    out = docs.select(*[c for c in docs.columns if c not in added], finder(spread)(text_or_empty()).alias("__f"))
    return out.select("*", *[F.col(f"__f.{c}").alias(c) for c in counts], F.col("__f.base").alias("base_spans"),
                      F.col("__f.spans").alias("spans")).drop("__f")


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans",
                      n_spans.alias("n_spans"))
