"""Secrets: fixed patterns, and tokens that look random to two character models.

A first-order Markov model of the characters of random strings and one of
ordinary ones (identifiers, words, numbers, rulers) are trained from labelled
samples; a token's score is the mean log-likelihood ratio per character.  Every
maximal run of at least MIN_VALUE characters of the alphabet is a token (a dot
separates); those over the threshold, which is set on held-out samples for at most
one ordinary string in MISSES, are added to the spans of the patterns.  Each text is scanned whole inside its Arrow batch.

Cases: null and empty texts have no spans; positions are code points, ends
exclusive; spans of one kind never overlap; a random token that meets a pattern's
span is left out; repeated rows give equal rows; no row is dropped.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
MIN_VALUE = 12

TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_VALUE},}}")
SAMPLES = 6000
MISSES = 1000

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

# Words that ordinary identifiers are made of.
WORDS = """account action active address admin array async author backup balance base batch block body buffer build button
cache call cell channel check child class client close code color column command comment config connection content context
control copy count create current customer data date default delete description detail device directory display document
domain download element email enable end entry error event export feature field file filter first flag folder font format
frame function get global graph group handler hash header height help history hook host icon image import index info input
insert instance item job key label language last layout length level library limit line link list load local location lock
log main manager map margin menu message method mode model module name network node number object offset option order output
page panel parent parse password path pattern payment player plugin point policy position price print process product profile
project property public query queue random range read record reference region register release remote render report request
reset resource response result return role root route row rule sample schema scope screen script search section select send
server service session set shape size sort source stack start state status step storage stream string style submit support
switch symbol system table target task template test text thread time title token tool total track type unit update upload
user value version video view visible width window word worker write zone""".split()

# Words of running text: English, French, Spanish and German.
PROSE = """about after again against although because before between business certain children community company condition
consider continue country decision development different education environment everything experience following government
however important including increase information interest international knowledge language management national necessary
nothing organisation particular people perhaps possible president probably problem production programme question research
something therefore together understand university without yesterday
alors apres aujourd avant avoir beaucoup besoin cette chaque chose comme comprendre croissance depuis developpement
economique encore ensemble enfant entreprise etre gouvernement histoire jamais jour leur longtemps maintenant meilleur
moment monde nouveau parce parfois personne peuple plusieurs pourquoi premier quelque question raison reponse semaine
toujours travail utilisation vraiment
ahora algunos antes aunque ayuda cada ciudad conocimiento cuando desarrollo despues donde durante ejemplo empresa entonces
espacio experiencia familia gobierno hacer historia importante informacion lugar manera mejor mientras mismo momento mucho
nacional necesidad ninguno nuestro nuevo palabra pequeno persona porque primero problema programa proyecto pueblo siempre
sistema tambien tiempo todavia trabajo
aber achtung allgemein anderen arbeit aufgabe ausbildung bedeutung beispiel besonders bezirk bildung damit deutsch dienst
einfach entwicklung erfahrung erste forschung freiheit ganz gemeinschaft geschichte gesellschaft gesetz gesundheit gross
haupt immer jahr keine kraft kunst land leben leistung mensch moeglichkeit nachricht nichts ordnung pflicht pfund platz
politik recht schaft schiff schule schutz sicherheit sprache staat stadt strasse unternehmen verfahren verkehr versicherung
verwaltung vielleicht wirtschaft wissenschaft zeit zukunft zwischen""".split()


def random_sample(rng: random.Random, least: int = 20) -> str:
    kind, n = rng.randrange(4), rng.randint(least, 44)
    letters = (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62] + "_-", ALPHABET[:26] + ALPHABET[52:62])[kind]
    return "".join(rng.choice(letters) for _ in range(n))


def ordinary_sample(rng: random.Random, least: int = 18) -> str:
    """A compound of words in one of the usual spellings, with an index, a version or a date at times."""
    parts: list[str] = []
    while len("".join(parts)) < least:
        parts.append(rng.choice(WORDS))
    kind = rng.randrange(5)
    if kind == 0:
        text = "".join(p.capitalize() for p in parts)
    elif kind == 1:
        text = parts[0] + "".join(p.capitalize() for p in parts[1:])
    else:
        text = "_-/"[kind - 2].join(parts)
    if rng.random() < 0.1:
        text = text.upper()
    tail = rng.randrange(4)
    return text + ("", str(rng.randint(0, 99)), f"_v{rng.randint(1, 20)}", f"-20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 30)}")[tail]


def running_sample(rng: random.Random) -> str:
    """Words of running text, joined or with dashes or slashes; a number, a date or groups of digits; a ruler."""
    kind = rng.randrange(10)
    if kind == 0:
        return rng.choice("-=_+/") * rng.randint(MIN_VALUE, 80)
    if kind == 1:
        return "".join(rng.choice("0123456789") for _ in range(rng.randint(MIN_VALUE, 24)))
    if kind == 2:
        mark = rng.choice("-/_")
        return mark.join(str(rng.randint(10 ** (n - 1), 10 ** n - 1)) for n in rng.choices((2, 3, 4), k=5))
    text = rng.choice(PROSE)
    while len(text) < MIN_VALUE:
        text += rng.choice(("", "", "", "", "-", "/", "_")) + rng.choice(PROSE)
    return rng.choice((text, text, text, text.capitalize(), text.upper()))


def steps(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each character and the one before it (a start mark first)."""
    code = CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
    return np.concatenate(([len(ALPHABET)], code[:-1])), code


def transition_model(samples: list[str]) -> np.ndarray:
    """Log-probability of each character after each other, one added to every count."""
    n = len(ALPHABET) + 1
    counts = np.ones((n, n))
    for text in samples:
        np.add.at(counts, steps(text), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class RatioTest:
    ratio: np.ndarray
    threshold: float

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio per character: over 0, closer to random strings."""
        return float(self.ratio[steps(text)].mean())


def trained(samples: list[tuple[str, int]]) -> RatioTest:
    """From labelled samples (text, 1 if random): every fifth sample sets the threshold, the rest the models."""
    learn = [x for k, x in enumerate(samples) if k % 5]
    model = RatioTest(transition_model([t for t, y in learn if y]) - transition_model([t for t, y in learn if not y]), 0.0)
    plain = sorted((model.score(t) for t, y in samples[::5] if not y), reverse=True)
    return RatioTest(model.ratio, max(plain[len(plain) // MISSES], 0.0))


@lru_cache(maxsize=1)
def default_test(seed: int = 11) -> RatioTest:
    """Trained on SAMPLES made strings of each class."""
    rng = random.Random(seed)
    ordinary = lambda k: running_sample(rng) if k % 4 else ordinary_sample(rng, MIN_VALUE)
    made = [(random_sample(rng, MIN_VALUE), 1) if k % 2 else (ordinary(k), 0) for k in range(2 * SAMPLES)]
    rng.shuffle(made)
    return trained(made)


ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}


def found(text: str, model: RatioTest) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ORDER, end), rising."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_VALUE]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    added = []
    for m in TOKEN.finditer(text):
        if model.score(m[0]) > model.threshold and not any(s < m.end() and m.start() < e for s, _, e in spans):
            added.append((m.start(), 3, m.end()))
    return sorted(spans + added)


RESULT = "doc_id {}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: RatioTest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: counts by kind, the digest of the patterns' spans, all spans."""
    test = model or default_test()
    names = list(ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = found(text.as_py() or "", test)
                said = [f"{names[k]}:{s}:{e}" for s, k, e in spans]
                base = ",".join(x for x, (_, k, _) in zip(said, spans, strict=True) if k < 3)
                counts = [sum(k == j for _, k, _ in spans) for j in range(4)]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, RESULT.format(rows.schema["doc_id"].dataType.simpleString()))
