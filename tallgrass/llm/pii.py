"""Operator 11: personal data in texts, by patterns and a linear-chain conditional random field.

Patterns.  E-mail addresses, IPv4 addresses, card and phone numbers in their plain forms are found
by rules (`base_spans`), each in linear time, so a very long run of digits or letters costs no more.

The field adds spans that the patterns can't have: written-out or bracketed addresses, numbers with
other separators, phone numbers without a plus.  A text is cut into runs of letters, runs of digits and
single signs.  Each has a class, made of its word shape, whether white space comes before it, and the
word itself if the labelled table has it often.  A label (outside, or begin or inside of a kind) is
scored by the classes of the token and its two neighbours on each side, and by the label before it.
Labels other than outside are allowed only within REACH tokens of a core: digits, an at sign, a
written-out dot, or a dot between letters.  The rest is outside by construction, both in training and in
decoding, so that a text falls apart into short runs, which Viterbi decodes in numpy, many at once.
What comes out is held to the kind's form (`_valid`: digits of a card pass Luhn's test, and so on), and
a span that overlaps one of the patterns' is left out: those always stay.

Training.  `labelled` makes the labelled table from written examples, numbers drawn by a seed; `fit`
takes any table of that form, of which it reads TRAIN_ROWS rows at most, and maximises the likelihood
by gradient steps on exact forward and backward sums in the driver.  The model is a few thousand floats.

Cases: null and empty texts have no spans; very long texts are read whole; repeated rows have a result
each; a null doc_id is kept; spans are ordered by kind and start, and patterns of different kinds may
overlap each other; an empty table gives no rows.  Of the input's columns only doc_id and text are read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Rows of a labelled table that are read for training.
TRAIN_ROWS = 4_000
#: Labels other than outside are allowed within so many tokens of a core.
REACH = 6
#: Neighbours on each side whose classes score a label.
SIDE = 2
#: A word that the labelled table has so often has a class of its own.
OFTEN = 4
#: Tokens whose classes a worker remembers.
MEMO_TOKENS = 200_000
#: Cells of a block of runs that Viterbi decodes at once.
BLOCK = 1 << 17

#: The patterns' parts.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Ways to write a dot, or an at sign, in words.
DOTS = ("dot", "punkt", "punto", "point")
ATS = ("at", "arobase", "arroba")
LETTER = "A-Za-zªµºÀ-ÖØ-öø-˿"
TOKEN = re.compile(rf"\s?(?:[{LETTER}]+|[0-9]+|\S)|\s")
DIGIT_OR_AT = re.compile("[0-9@]")
DOT_BETWEEN = re.compile(rf"(?<=[{LETTER}])\.(?=[{LETTER}])")
DOT_WORD = re.compile(rf"(?<![{LETTER}])(?:{'|'.join(DOTS)})(?![{LETTER}])", re.IGNORECASE)


# ---- patterns ----


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    """At most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and start; the leftmost of overlapping ones of a kind."""
    found: list[tuple[str, int, int]] = []
    if not DIGIT_OR_AT.search(text):
        return found
    end, at = 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        end = domain.end() if domain else at + 1  # an address before it can't reach over an at sign
        if domain:
            found.append(("email", start, end))
        at = text.find("@", end)
    for m in NUMBERS.finditer(text):
        if m[0].count(".") >= 3:
            parts, start = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                stop = start + sum(map(len, four)) + 3
                if all(map(_small, four)):
                    found.append(("ip", start, stop))
                start = stop + 1
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# ---- the labelled table ----

#: Labelled examples: personal data in [kind|...]; # is a digit, % a name, ~ a made-up word.
EXAMPLES = """
call me on [phone|###-###-####] after work
Call [phone|(###) ###-####] today.
her phone is [phone|### ### ####], his is [phone|### ### ####]
Phone: [phone|###.###.####]
my number is [phone|### ####] or [phone|###-####]
Tel.: [phone|0## #######]
Tel. [phone|0### / ######]
Telefon [phone|0###-######], Fax [phone|0###-######]
Rufen Sie [phone|(0##) #######] an
telefon: [phone|00## ## #######]
appelez le [phone|0# ## ## ## ##] ce soir
Tél : [phone|0#.##.##.##.##]
llame al [phone|### ### ###] o al [phone|## ### ## ##]
Teléfono: [phone|### ## ## ##]
mobile [phone|07### ######]
fax [phone|1-###-###-####] ~ ~
text [phone|##########] to win
whatsapp [phone|0### ### ## ##]
ring [phone|0## #### ####] or write to [email|% at ~ dot com]
~ ~ phone [phone|###-###-####] ~ ~
write to [email|% at ~ dot org] please
mail: [email|% (at) ~ (dot) com]
mail [email|%[at]~[dot]net]
[email|%.% at ~.com] ~ ~
contact [email|% AT ~ DOT com] for more
Schreib an [email|% at ~ punkt de] heute
e-mail: [email|%(at)~.de]
[email|%{at}~.org]
mon adresse est [email|% arobase ~ point fr]
escribe a [email|% arroba ~ punto es]
my address is [email|% @ ~ . com]
reach [email|%## at ~ dot com] any time
send it to [email|% dot % at ~ dot co dot uk]
~ ~ [email|%_% (at) ~ dot org] ~
~ [email|%[at]~.net], ~ ~
his card is [card|####.####.####.####]
card number [card|####/####/####/####]
Visa [card|####_####_####_####] exp ##/##
amex [card|#### ###### #####]
credit card: [card|####.####.####.####], cvc ###
Karte [card|####.####.####.####] bitte
carte [card|####/####/####/####]
tarjeta [card|#### ###### #####] ~
pay with [card|#### ###### #####] now
~ card [card|####_####_####_####] ~ ~
server at [ip|##[.]###[.]##[.]#]
ip [ip|###[.]##[.]#[.]###] was blocked
host [ip|## . ### . # . ##] is down
IP [ip|###(.)##(.)#(.)##]
connect to [ip|## dot ### dot # dot ##]
adresse ip [ip|###[.]##[.]##[.]##]
~ ip [ip|## dot ## dot ## dot ##] ~
on 20##-0#-1# at ##:## we met
am ##.##.20## um ##:## Uhr
le ##/##/20## à ##h##
el ## de ~ de 20##
version #.#.# of ~
see pages ###-### and ###
it costs $#,###.## or ###.## euros
ISBN 978-#-##-######-#
ISBN: 978##########
order 20##0###-#### was sent
invoice no. ######## of ##.##.20##
room ### on floor #
chapter #.#.# has ## pages
lat ##.####, lon ##.####
they won #:# and #:#
token = "ae#c#b##d#f###e#"
sha ##ae#f##c##
call him at # or at ##
call ~ # times a day
phone ~ in ## days
look at ~.com for more
see www.~.org and ~.net
open file.txt at ~
at the point where ~ stopped
the dot at the end of ~
a point at which ~ ~
Punkt ## der Liste von ~
connect the dots at ~ and ~
~ ~ at ~ ~. ~ ~
~ ~ ~ ~ ~.
~ ~, ~ ~ ~ ~ ##.
## ~ ~ ~ ### ~
~ #### ~ ~ ########## ~ ~
~ ################ ~ ~
~ ~ #,###,### ~ ~ ##.#
~.~ ~ ~
~ ~.~ ~ ##
§ ## ~ ~ #### ~
population ####### in 20##
from ### to ###, then #### - ####
ratio ## : ## : ##
tracking 1Z##########
serial ####-####-####
id: ############
account ##########
isbn #-###-#####-#
line ##, column ###
size ## x ## x ##
temperature ##.# at ##:##
~ dot ~ ~ point ~
""".strip().splitlines()  # fmt: skip
NAMES = "anna ben carla david emma felix greta hugo ines jonas karl lena marco nina otto paula rosa sam tom vera".split()
SYLLABLES = "an be cor da el fi gan ho in ja ker lo mi nu or pa que ru st tion um ver wo xy za ä é".split()


def _made_up(rnd: random.Random) -> str:
    word = "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))
    return word.capitalize() if rnd.random() < 0.15 else word


def labelled(spark: SparkSession, rounds: int = 12, seed: int = 11) -> DataFrame:
    """text, spans: each example `rounds` times, with other numbers, names and words."""
    rnd, rows = random.Random(seed), []
    draws = {"#": lambda: str(rnd.randrange(10)), "%": lambda: rnd.choice(NAMES), "~": lambda: _made_up(rnd)}
    for example in EXAMPLES * rounds:
        text, spans = "", []
        for part in re.split(r"(\[(?:email|ip|card|phone)\|(?:\[[.at do]+\]|[^\]])+\])", example):
            kind, bar, inner = part.partition("|") if part.startswith("[") else ("", "", "")
            start = len(text)
            for c in inner[:-1] if bar else part:
                text += draws.get(c, lambda c=c: c)()
            if bar:
                spans.append((kind[1:], start, len(text)))
        rows.append((text, spans))
    return spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,end:int>>")


# ---- tokens and classes ----


def _features(token: str) -> tuple[str, ...]:
    """What a token's class is made of: whether white space comes before it, its shape, and the word."""
    word = token.lstrip()
    glued = "glued" if word == token else "apart"
    if not word:
        return ("space",)
    if word[0].isdecimal() and word.isascii():
        n = len(word)
        shape = f"digits {n if n < 5 else '5-8' if n < 9 else '9-15' if n < 16 else '16+'}"
        return (shape, f"{glued} {shape}")
    if not word[0].isalpha():
        return (f"sign {word}", f"{glued} sign {word}") if word.isascii() else ("other sign",)
    shape = "lower" if word.islower() else "upper" if word.isupper() and len(word) > 1 else "title" if word.istitle() else "mixed"
    size = "short" if len(word) < 3 else "long" if len(word) > 12 else "word"
    return (shape, size, f"{glued} {'letters'}", f"= {word.lower()}")


class Field:
    """A trained field: classes by their features, and the scores of labels."""

    def __init__(self, features: Sequence[str], scores: np.ndarray, steps: np.ndarray):
        self.feature_at = {f: i for i, f in enumerate(features)}
        #: scores[offset, feature, label]; steps[label before, label].
        self.scores, self.steps = scores, steps
        self.class_at: dict[tuple[int, ...], int] = {(): 0}
        self.core, self.dot, self.letters_glued, self.letters = [False], [False], [False], [False]
        self.tables = [np.zeros((2 * SIDE + 1, scores.shape[2]))]
        self.memo: dict[str, int] = {}

    def __getstate__(self):
        return list(self.feature_at), self.scores, self.steps

    def __setstate__(self, state):
        self.__init__(*state)

    def class_of(self, token: str) -> int:
        """The class of a token; 0 is that of no token, as beside a text."""
        if not token:
            return 0
        told = _features(token)
        word = token.strip()
        letters = bool(word) and word[0].isalpha()
        known = tuple(sorted(self.feature_at[f] for f in told if f in self.feature_at))
        flags = (word.isascii() and word.isdecimal()) or word == "@" or word.lower() in DOTS, word == "." == token, letters and word == token, letters
        key = (*known, *flags)
        at = self.class_at.get(key)
        if at is None:
            at = self.class_at[key] = len(self.tables)
            self.tables.append(self.scores[:, list(known)].sum(axis=1))
            for flag, own in zip(flags, (self.core, self.dot, self.letters_glued, self.letters)):
                own.append(flag)
        return at

    def classes(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_TOKENS:
            memo.clear()
        for token in set(tokens).difference(memo):
            memo[token] = self.class_of(token)
        return np.fromiter(map(memo.__getitem__, tokens), np.int32, len(tokens))

    def allowed(self, classes: np.ndarray) -> np.ndarray:
        """Which tokens may have a label: those within REACH of a core."""
        flag = lambda own: np.array(own)[classes]
        core = flag(self.core)
        # a dot between letters without white space
        core[1:-1] |= flag(self.dot)[1:-1] & flag(self.letters)[:-2] & flag(self.letters_glued)[2:]
        seen = np.concatenate(([0], np.cumsum(core)))
        here = np.arange(len(core))
        return seen[np.minimum(here + REACH + 1, len(core))] > seen[np.maximum(here - REACH, 0)]

    def emissions(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of the labels of the tokens at `at`."""
        tables = np.array(self.tables)
        return sum(tables[classes[np.clip(at + off, 0, len(classes) - 1)], off + SIDE] for off in range(-SIDE, SIDE + 1))

    def decode(self, classes: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Labels of all tokens; runs of allowed ones are decoded apart, blocks of runs of like length at once."""
        labels = np.zeros(len(classes), np.int8)
        edge = np.diff(np.concatenate(([0], allowed.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        order = np.argsort(ends - starts, kind="stable")
        while len(order):
            longest = (ends - starts)[order]
            # a block: runs up to twice as long as its shortest, in BLOCK cells or one run
            n = max(1, min(np.searchsorted(longest, 2 * longest[0], side="right"), BLOCK // (2 * int(longest[0]))))
            rows, order = order[:n], order[n:]
            self._viterbi(classes, starts[rows], (ends - starts)[rows], labels)
        return labels

    def _viterbi(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        steps, most = self.steps, int(sizes.max())
        # before and after a run comes an outside token
        best = steps[0] + self.emissions(classes, starts)
        back = np.empty((most, len(starts), steps.shape[0]), np.int8)
        last = np.zeros(len(starts), np.int8)
        for t in range(1, most + 1):
            done = sizes == t
            if done.any():
                last[done] = (best[done] + steps[:, 0]).argmax(axis=1)
            if t == most:
                break
            ways = best[:, :, None] + steps
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + self.emissions(classes, np.minimum(starts + t, starts + sizes - 1))
        rows = np.arange(len(starts))
        for t in range(most - 1, -1, -1):
            here = t < sizes
            labels[starts[here] + t] = last[here]
            if t:
                last = np.where(here, back[t][rows, last], last)


# ---- training ----

LABELS = 1 + 2 * len(KINDS)


def _targets(text: str, tokens: list[str], spans) -> np.ndarray:
    """The label of each token: 0, or 1 + 2 * kind for the first of a span and one more for the others."""
    labels = np.zeros(len(tokens), np.int64)
    at = 0
    first = {}
    for i, token in enumerate(tokens):
        start = at + len(token) - len(token.lstrip())
        at += len(token)
        for n, (kind, s, e) in enumerate(spans):
            if s <= start < e:
                labels[i] = 1 + 2 * KINDS.index(kind) + (n in first)
                first[n] = i
    return labels


def fit(table: DataFrame, rows: int = TRAIN_ROWS, passes: int = 150, rate: float = 0.15, shrink: float = 0.02) -> Field:
    """A field from labelled rows (text, spans), of which the first `rows` by a hash of the text are read.

    Gradient steps with momentum and scaled by past squares, on the log-likelihood of the allowed tokens;
    `shrink` is the weight of the squared scores.
    """
    told = table.select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(rows).collect()
    texts = [r["text"] for r in told]
    cut = [TOKEN.findall(t) for t in texts]
    counts = Counter(f for tokens in cut for token in tokens for f in _features(token))
    known = sorted(f for f, n in counts.items() if n >= OFTEN)
    n_features = len(known)
    field = Field(known, np.zeros((2 * SIDE + 1, n_features, LABELS)), np.zeros((LABELS, LABELS)))

    # all texts in a row, outside tokens between them; a row of `runs` is a run of allowed tokens
    feature_at = field.feature_at
    flat, labels = [], []
    for tokens, r in zip(cut, told):
        flat += [*tokens, *repeat("", REACH)]
        labels.append(np.concatenate((_targets(r["text"], tokens, [(s["kind"], s["start"], s["end"]) for s in r["spans"]]), np.zeros(REACH, np.int64))))
    target = np.concatenate(labels) if labels else np.zeros(0, np.int64)
    classes = field.classes(flat)
    allowed = field.allowed(classes) & (np.array([bool(t) for t in flat], bool) if flat else np.zeros(0, bool))
    if not allowed.any():
        return field
    # the features of each class, as a matrix, so that a class's scores are a product
    of_class = np.zeros((len(field.tables), n_features))
    for token in set(flat) - {""}:
        of_class[field.class_of(token), [feature_at[f] for f in _features(token) if f in feature_at]] = 1

    edge = np.diff(np.concatenate(([0], allowed.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    most = int((ends - starts).max())
    at = np.minimum(starts[:, None] + np.arange(most), len(flat) - 1)
    real = at < ends[:, None]
    near = np.stack([classes[np.clip(at + off, 0, len(flat) - 1)] for off in range(-SIDE, SIDE + 1)])
    truth = np.where(real, target[at], 0)
    one_hot = np.eye(LABELS)[truth] * real[..., None]
    before = np.concatenate((np.zeros((len(starts), 1), np.int64), truth), axis=1)
    pairs_true = np.zeros((LABELS, LABELS))
    np.add.at(pairs_true, (before[:, :-1][real], truth[real]), 1)
    np.add.at(pairs_true, (truth[np.arange(len(starts)), (ends - starts) - 1], 0), 1)

    scores, steps = field.scores, field.steps
    momentum = [np.zeros_like(scores), np.zeros_like(steps)]
    squares = [np.zeros_like(scores), np.zeros_like(steps)]
    for turn in range(1, passes + 1):
        by_class = np.stack([of_class @ scores[o] for o in range(2 * SIDE + 1)])
        emit = sum(by_class[o][near[o]] for o in range(2 * SIDE + 1))
        expected, pairs = _expected(emit, steps, real)
        miss = (one_hot - expected) * real[..., None]
        grads = [np.empty_like(scores), pairs_true - pairs - shrink * steps]
        for o in range(2 * SIDE + 1):
            summed = np.stack([np.bincount(near[o][real], own, len(of_class)) for own in miss[real].T], axis=1)
            grads[0][o] = of_class.T @ summed - shrink * scores[o]
        for value, grad, m, s in zip((scores, steps), grads, momentum, squares):
            m += 0.1 * (grad - m)
            s += 0.01 * (grad**2 - s)
            value += rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-8)
    return Field(known, scores, steps)


def _expected(emit: np.ndarray, steps: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels of each place and expected steps in total, by forward and backward sums, scaled at each place.

    A run starts after and ends before an outside token.
    """
    n, most, k = emit.shape
    emit = np.exp(emit - emit.max(axis=2, keepdims=True))
    steps = np.exp(steps - steps.max())
    scaled = lambda x: x / x.sum(axis=1, keepdims=True)
    ahead, behind = np.empty((n, most, k)), np.empty((n, most, k))
    ahead[:, 0] = scaled(steps[0] * emit[:, 0])
    for t in range(1, most):  # beyond its end a run keeps its last value
        ahead[:, t] = np.where(real[:, t, None], scaled((ahead[:, t - 1] @ steps) * emit[:, t]), ahead[:, t - 1])
    end = scaled(np.tile(steps[:, 0], (n, 1)))
    behind[:, -1] = end
    pairs = np.zeros((k, k))
    for t in range(most - 2, -1, -1):
        onward = behind[:, t + 1] * emit[:, t + 1]
        total = ((ahead[:, t] @ steps) * onward).sum(axis=1, keepdims=True)
        here = real[:, t + 1]
        pairs += (ahead[here, t] / total[here]).T @ onward[here] * steps
        behind[:, t] = np.where(here[:, None], scaled(onward @ steps.T), end)
    expected = ahead * behind
    expected /= expected.sum(axis=2, keepdims=True)
    pairs[0] += expected[:, 0].sum(axis=0)
    last = real.sum(axis=1) - 1
    pairs[:, 0] += expected[np.arange(n), last].sum(axis=0)
    return expected, pairs


# ---- spans ----

_PLAIN_DOT = re.compile(rf"\s*[\[({{]?\s*(?:\.|\b(?:{'|'.join(DOTS)})\b)\s*[\])}}]?\s*", re.IGNORECASE)
_PLAIN_AT = re.compile(rf"\s*[\[({{]?\s*(?:@|\b(?:{'|'.join(ATS)})\b)\s*[\])}}]?\s*", re.IGNORECASE)
_ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]+@{DOMAIN.pattern}")


def _valid(kind: str, text: str) -> bool:
    """Whether a span's text has its kind's form, once written-out signs are plain."""
    if kind == "email":
        return bool(_ADDRESS.fullmatch(_PLAIN_DOT.sub(".", _PLAIN_AT.sub("@", text))))
    digits = _digits(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    parts = re.findall("[0-9]+", text)
    return len(parts) == 4 and all(map(_small, parts))


def has_core(text: str) -> bool:
    """Whether any token may have a label."""
    if DIGIT_OR_AT.search(text) or DOT_BETWEEN.search(text):
        return True
    small = text.lower()
    return any(word in small for word in DOTS) and bool(DOT_WORD.search(text))


def added_spans(texts: Sequence[str], bases: Sequence[list], field: Field) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text that overlap none of its base spans."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    rows = [i for i, text in enumerate(texts) if has_core(text)]
    if not rows:
        return found
    cut = [TOKEN.findall(texts[i]) for i in rows]
    gap = [""] * REACH  # so no text is seen from another
    flat = list(chain.from_iterable(chain(tokens, gap) for tokens in cut))
    classes = field.classes(flat)
    allowed = field.allowed(classes)
    first = np.cumsum([0, *(len(tokens) + REACH for tokens in cut)])
    for begin, tokens in zip(first, cut):
        allowed[begin + len(tokens) : begin + len(tokens) + REACH] = False
    labels = field.decode(classes, allowed)
    hits = np.flatnonzero(labels)
    if not len(hits):
        return found
    stops = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
    kinds = (labels - 1) // 2
    # a span begins at a beginning, or where an inside label has no span of its kind before it
    begins = hits[(labels[hits] % 2 == 1) | (hits == 0) | (labels[hits - 1] == 0) | (kinds[hits - 1] != kinds[hits])]
    ends = hits[np.append(np.diff(hits) > 1, True)]
    for i, begin in enumerate(begins):
        end = int(ends[np.searchsorted(ends, begin)])
        if i + 1 < len(begins):
            end = min(end, int(begins[i + 1]) - 1)
        row = int(np.searchsorted(first, begin, side="right")) - 1
        origin = int(stops[first[row] - 1]) if first[row] else 0
        stop = int(stops[end]) - origin
        start = int(stops[begin]) - len(flat[begin].lstrip()) - origin
        text = texts[rows[row]]
        kind = KINDS[kinds[begin]]
        if _valid(kind, text[start:stop]) and not any(s < stop and start < e for _, s, e in bases[rows[row]]):
            found[rows[row]].append((kind, start, stop))
    return found


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def _spans_of(column: pa.Array, field: Field) -> pa.Array:
    texts = [t or "" for t in column.to_pylist()]
    bases = [base_spans(t) for t in texts]
    out = []
    for base, added in zip(bases, added_spans(texts, bases, field)):
        both = [(*s, True) for s in base] + [(*s, False) for s in added]
        both.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append([dict(zip(("kind", "start", "end", "base"), s)) for s in both])
    return pa.array(out, pa.list_(_SPAN))


def spans(text: Column, field: Field) -> Column:
    """array of struct(kind, start, end, base): code points, end exclusive, by kind in the order of KINDS and start."""

    @F.arrow_udf(SPANS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(partial(_spans_of, field=field), batches)

    return found(text)


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, spans: one row for each row of `docs`."""
    return docs.select("doc_id", spans(F.col("text"), field).alias("spans"))


def told(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of those, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *(of_kind(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
