"""Operator 7 [native]: secret scans by rules and by character Markov models.

Rules find assignments, access keys and hexadecimal runs.  Beside them, tokens (maximal
runs of token characters, 20 or longer) are scored by two first-order Markov models of
characters, one of random strings and one of ordinary identifiers: the mean log-likelihood
ratio per transition.  Models are trained from labelled samples (text, random): `samples`
gives one, of any size.  The default samples are made from rules and don't depend on the
texts scanned: strings of digests in several alphabets as random ones; words of everyday
and program vocabulary joined in the usual styles, numbers and runs as ordinary ones.

Positions are code points, end exclusive; they follow from the lengths of the text between
matches and of the matches, so no pass over the text runs on a row without a match, and
running sums are made in parts, so a text with very many matches costs little more than
linear time.

Defined cases: null text counts as empty and has no spans; empty tables give empty results;
a sample without rows of a label leaves that model uniform, null samples count as empty;
texts of any length are scanned whole; repeated rows are scanned each; columns that docs
has beside the text pass through, whatever their names (a `spans` column is replaced).
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scan as running

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the runs of AKIA[A-Z0-9]+ with 18 characters or more
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ with 16 characters or more
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Random strings and joined names in the default samples.
SAMPLE_RANDOM, SAMPLE_NAMES = 4000, 4000
#: Least mean log-likelihood ratio per transition (nats) of a secret.
THRESHOLD = 0.7
#: Words that names are made of, in English and some other languages.
VOCABULARY = """
account action active address after allow amount angle anchor answer append archive area array article asset author average
background balance before begin below block board border bottom branch bridge broken browser buffer build button cache call
camera cancel center change channel charge check child choose class clean client close cloud code collect color column command
comment common compare complete config connect content context control convert count country create current custom daily data
database date debug decode default delete deliver device dialog digital direct disable display document domain double download
driver dynamic edit element empty enable encode engine enter entity error event every example execute exist export extend factory
feature fetch field file filter final find first float folder follow force form format forward frame friend function gallery
general generate global graph green group growth handle hash header health height hidden history hour house image import index
info inner input insert install instance integer internal item iterator join kernel keyboard label language large last layer layout
left length level library light limit line list load local location lock login long loop machine main manage map market master match
maximum measure member memory menu message method minimum minute mobile mode model module money month mouse move multiple name native
network never new next node normal note notify number object offset open operation option order origin output owner package page
paint panel parameter parent parse partial password path pattern payment people percent permission phone picture place player plugin
point policy position post power prefix present preview previous price print private process product profile program project property
provider public publish query queue quick random range rate read ready record reference refresh region register release remote
remove render repeat replace report request require reset resource response result return review right role root round route row rule
sample save scale schedule schema screen script search second section secure select send sequence server service session setting
shadow shape share short show signal simple single size small source space special split stack standard start state status step
stock stop storage store stream street string strong structure student style submit subject success summary support switch symbol
system table target task team template test text theme thread time title token tool top total track traffic transfer tree trigger type
under union unique unit update upload upper user valid value variable vector version video view visible voice wait warning water
weather web week weight white width window word work world wrapper write year zone
aber abteilung alle angabe arbeit auch ausgabe bedeutung beispiel beschreibung bild buch daten drei ein einheit ergebnis erste
fehler freiheit frage ganze gesellschaft gesundheit haus heute immer jahr kinder land leben liste mensch mitteilung nicht oder
ordnung recht richtung schreiben schule sicherheit sprache stadt stelle suche tag teil verein verbindung verwaltung wichtig wirtschaft
zeichen zeit zwischen avec autre bonjour chemin cette comme compte dans depuis elle encore entre etat exemple faire fichier fois
grand heure homme jour langue liste maison monde nombre nouveau parole partie petit personne premier quelque recherche rien semaine
tout travail utilisateur valeur vie ville ahora algo amigo archivo bien cada calle camino ciudad como cuando datos desde donde ejemplo
entonces grande hombre idioma lista lugar manera mejor mismo momento mucho mundo nombre nuevo palabra pero persona pregunta primero
pueblo siempre sobre solamente tiempo todo trabajo usuario valor verdad vida nacimiento
""".split()


@lru_cache(1)
def default_samples() -> list[tuple[str, bool]]:
    """(text, random) by rule: the same wherever and on whatever table it runs."""
    digit = lambda *x: int(hashlib.sha256(":".join(map(str, x)).encode()).hexdigest(), 16)

    def spell(n: int, letters: str, size: int) -> str:
        out = []
        for _ in range(size):
            n, k = divmod(n, len(letters))
            out.append(letters[k])
        return "".join(out)

    plain = string.ascii_letters + string.digits
    sets = [plain, plain, plain + "+/", plain + "-_", string.digits + string.ascii_uppercase, string.ascii_lowercase + string.digits, "0123456789abcdef"]
    out = [(spell(digit("random", i), sets[i % len(sets)], 40), True) for i in range(SAMPLE_RANDOM)]
    styles = [
        "_".join, "-".join, "/".join, "".join, lambda w: "".join(x.title() for x in w), lambda w: "_".join(w).upper(),
        lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "-".join(w) + "-" + str(digit(*w) % 1000), lambda w: "".join(x + str(digit(x, *w) % 10) for x in w),
    ]
    for i in range(SAMPLE_NAMES):
        words = [VOCABULARY[digit("name", i, k) % len(VOCABULARY)] for k in range(5)]
        out.append((styles[i % len(styles)](words), False))
    out += [(c * 30, False) for c in "=-_+/" for _ in range(20)]
    out += [(f"{digit('n', i) % 10**4:04d}-{i % 12 + 1:02d}-{i % 28 + 1:02d}/{i:06d}", False) for i in range(300)]
    return out


def ratios_of(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters, flat: random against ordinary, from
    counts[random, first, second]."""
    step = np.log((counts + 0.5) / (counts + 0.5).sum(2, keepdims=True))
    return (step[1] - step[0]).ravel()


@lru_cache(1)
def default_ratios() -> np.ndarray:
    return train_local(default_samples())


def train_local(samples: Iterable[tuple[str, bool]]) -> np.ndarray:
    n, at = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    counts = np.zeros((2, n, n))
    for text, random in samples:
        for a, b in zip(text, text[1:]):
            if a in at and b in at:
                counts[int(random), at[a], at[b]] += 1
    return ratios_of(counts)


def train(samples: DataFrame) -> np.ndarray:
    """The ratios of labelled samples (text, random) of any number, counted in one pass."""
    n = len(ALPHABET)
    chars = samples.select(F.split("text", "").alias("c"), "random")
    pair = F.explode(F.transform(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.get("c", i + 1).alias("b"))))
    counts = np.zeros((2, n, n))
    at = {c: i for i, c in enumerate(ALPHABET)}
    known = chars.select(pair.alias("p"), "random").where(F.col("p.a").isin(*ALPHABET) & F.col("p.b").isin(*ALPHABET) & F.col("random").isNotNull())
    for a, b, random, k in known.groupBy("p.a", "p.b", "random").count().collect():  # 2 n^2 rows at most
        counts[int(random), at[a], at[b]] += k
    return ratios_of(counts)


def score(token: Column, ratios: np.ndarray) -> Column:
    """Mean log-likelihood ratio per transition of a token of ALPHABET characters."""
    n = len(ALPHABET)
    code = np.zeros(128, np.int32)
    for i, c in enumerate(ALPHABET):
        code[ord(c)] = i
    codes, table = F.lit(code), F.lit(ratios)

    def mean(c: Column) -> Column:
        each = F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.get(table, x * n + F.get(c, i + 1)))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(c) - 1, F.lit(1))

    return let(F.transform(F.split(token, ""), lambda ch: F.get(codes, F.ascii(ch))), mean)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans (s, k, e) of the matches in order; keep(match) filters them."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    if keep is None:
        keep = lambda m: F.lit(True)
    zipped = F.zip_with(
        hits, F.slice(gaps, 1, F.size(hits)),
        lambda m, g: F.struct(F.char_length(m).alias("m"), F.char_length(g).alias("g"), keep(m).alias("ok")),
    )

    def placed(z: Column) -> Column:
        at = running(F.transform(z, lambda x: x["g"] + x["m"]), F.lit(0), lambda a, x: a + x)
        span = lambda x, a: F.when(x["ok"], F.struct((a + x["g"]).alias("s"), F.lit(kind).alias("k"), (a + x["g"] + x["m"]).alias("e")))
        return F.filter(F.zip_with(z, at, span), lambda x: x.isNotNull())

    return F.when(text.rlike(pattern), let(zipped, placed)).otherwise(_none())


def _apart(base: Column, more: Column) -> Column:
    """base, and those of more that touch none of it, sorted: a span is apart if all of base
    that begins before it has ended, and the next begins after it."""
    far = 2**31 - 1

    def kept(every: Column) -> Column:
        ends = running(F.transform(every, lambda x: F.when(x["k"] < 3, x["e"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        back = F.reverse(F.transform(every, lambda x: F.when(x["k"] < 3, x["s"]).otherwise(far)))
        begins = F.reverse(running(back, F.lit(far), lambda a, x: F.least(a, x)))
        free = F.zip_with(ends, begins, lambda e, b: F.struct(e.alias("e"), b.alias("b")))
        mine = F.zip_with(every, free, lambda x, f: F.when((x["k"] < 3) | ((f["e"] <= x["s"]) & (f["b"] >= x["e"])), x))
        return F.filter(mine, lambda x: x.isNotNull())

    return F.when(F.size(more) == 0, F.sort_array(base)).otherwise(let(F.sort_array(F.concat(base, more)), kept))


def scan(docs: DataFrame, text: str = "text", samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with spans: array<struct<s int, k int, e int>> by start, then kind (KINDS[k]).

    Kind 3 holds tokens that the models call random and no rule's span touches.
    """
    ratios = default_ratios() if samples is None else train(samples)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    assigned = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    base = F.concat(
        F.when(F.contains(whole, F.lit(":")) | F.contains(whole, F.lit("=")), _spans(whole, ASSIGN, 0, assigned)).otherwise(_none()),
        F.when(F.contains(whole, F.lit("AKIA")), _spans(whole, ACCESS, 1)).otherwise(_none()),
        _spans(whole, HEX, 2),
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "spans"]
    out = docs.select(*kept, base.alias("\x01base"), _spans(whole, TOKEN, 3, lambda m: score(m, ratios) >= threshold).alias("\x01more"))
    return out.select(*kept, _apart(F.col("\x01base"), F.col("\x01more")).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: int) -> Column:
    return F.filter(spans, lambda x: x["k"].isin(*kinds))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each union of overlapping spans replaced by the mark."""

    def step(a: Column, x: Column) -> Column:
        new = x["s"] >= a["at"]
        return F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(new, F.concat(a["parts"], F.array(text.substr(a["at"] + 1, x["s"] - a["at"]), F.lit(mark)))).otherwise(a["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    done = lambda a: F.concat(F.array_join(a["parts"], ""), text.substr(a["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, done))
