"""Personal data: detected entities get keyed surrogates of the same type and format.

An entity is its type and its canonical form (letter case and separators taken away), so
mentions in different dress are the same entity everywhere.  Its surrogate is made from
a keyed hash of type, canonical form and a try number: digits become digits, letters
become letters of the same script, and what a type needs is kept or made right: country
codes, top-level domains, the shared domain of addresses, octets, issuer digit and check
digit of cards, titles and the gender of given names.  It is written in the dress of
the mention.

Collisions are checked over all entities of the corpus: two entities must not share a
surrogate, and none may be an entity that occurs.  Of those that collide all but one,
or the one itself when it occurs, take the next try, until nothing collides.  Entities
past the first try are few; they are joined to the documents that hold them.
"""

from __future__ import annotations

import copy
import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import slices
from riskloom.staging import stage

#: Titles before names with their gender.
TITLES = {"mr": "m", "mister": "m", "herr": "m", "monsieur": "m", "señor": "m", "г-н": "m",
          "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "г-жа": "f"}
_NAME = r"[^\W\d_a-zß-öø-ÿа-я][^\W\d_]+(?:[-'’][^\W\d_]+)*"
PATTERNS = (
    ("email", r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[bp])[-_][0-9A-Za-z_-]{16,})(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9.+-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9.-]*[0-9])"),
    ("phone", r"(?<![0-9A-Za-z.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("name", r"(?i:\b(?:" + "|".join(TITLES) + r"))\.? " + _NAME + r"(?: " + _NAME + r")?"),
)
#: Letters of titles with all characters that Python's matching takes for them; engines differ in that and in word boundaries.
_FOLDS = {c: "".join(x for x in map(chr, range(0x2200)) if re.match(c, x, re.IGNORECASE)) for c in set("".join(TITLES)) - {"-"}}
#: Texts without this hold no entity.  Read by Arrow's engine and by Spark's, so it has only what both read alike.
MAY_HOLD = (r"[0-9@]|[A-F]{32}|[a-f]{32}|(AKIA|ASIA|sk|pk|ghp|gho|xox[bp])|("
            + "|".join("".join(f"[{_FOLDS[c]}]" if c in _FOLDS else c for c in t) for t in TITLES) + r")\.? ")
#: Bits of the bitmap that tells rows with entities past their first try.
SLOTS = 1 << 21
#: Bytes of text rewritten at a time.
SLICE = 2 << 20
_SCRIPTS = (("a", "z", "abcdefghijklmnopqrstuvwxyz"), ("а", "я", "абвгдежзийклмнопрстуфхцчшщыьэюя"), ("α", "ω", "αβγδεζηθικλμνξοπρστυφχψω"))
_VOWELS = {"a": "aeiou", "а": "аеиоу", "α": "αειου"}


def find(text: str) -> list[tuple[int, int, str]]:
    """Entities of a text, left to right: start, end, type.  Earlier patterns win over later ones they overlap."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS:
        new, at = [], 0
        # Matches and the spans taken are both in order and free of overlaps, so one walk over both is enough.
        for m in re.finditer(pattern, text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or m.end() <= taken[at][0]:
                new.append((m.start(), m.end(), kind))
        taken = sorted(taken + new)
    return taken


def parts(kind: str, mention: str) -> list[tuple[int, int, str, str]]:
    """Entities inside a mention: offset, end, type with what the surrogate depends on, canonical form.  Names give one each."""
    if kind != "name":
        canon = mention.lower() if kind == "email" else re.sub(r"[^0-9A-Za-z]", "", mention) if kind in ("card", "phone", "iban", "ssn") else mention
        return [(0, len(mention), kind, canon)]
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", mention)]
    gender = TITLES.get(mention[:words[0][1]].rstrip(".").lower(), "")
    names = [(a, b - 2 if re.search(r"..['’]s$", mention[a:b]) else b) for a, b in words[1:]]
    return [(a, b, f"given-{gender}" if len(names) > 1 and i == 0 else "family", mention[a:b].lower()) for i, (a, b) in enumerate(names)]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """All mentions in a text, left to right: start, end, type, canonical form.

    Names found behind titles are also replaced where they stand without one: as whole words
    of any capitalised form.  A word that is a given and a family name is the given name right
    before a family name, else the family name; of several given names it is the one that
    came with that family name, or the first.
    """
    spans = find(text)
    out, given, family, forms = [], {}, set(), set()
    for s, e, kind in spans:
        inside = [(s + a, s + b, k, c) for a, b, k, c in parts(kind, text[s:e])]
        out += inside
        if kind == "name":
            last = inside[-1][3]
            family.add(last)
            for a, b, k, c in inside:
                forms.add(text[a:b])
                if k != "family":
                    given.setdefault(c, {}).setdefault(last, k)
    if not forms:
        return out
    anyone = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(x) for x in sorted(forms, key=lambda x: (-len(x), x))) + r")(?!\w)", re.IGNORECASE)
    starts = [s for s, _, _ in spans]
    bare = []
    for m in anyone.finditer(text):
        at = bisect_right(starts, m.start())
        free = (at == 0 or spans[at - 1][1] <= m.start()) and (at == len(spans) or m.end() <= spans[at][0])
        if free and not m[0][0].islower() and (m[0].lower() in family or m[0].lower() in given):
            bare.append((m.start(), m.end(), m[0].lower()))
    for i, (s, e, c) in enumerate(bare):
        after = bare[i + 1] if i + 1 < len(bare) and text[e:bare[i + 1][0]] == " " and bare[i + 1][2] in family else None
        first = c in given and (c not in family or after is not None)
        out.append((s, e, given[c].get(after[2] if after else "", next(iter(given[c].values()))) if first else "family", c))
    return sorted(out)


class Maker:
    """Surrogates under a key."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode()).digest()

    def draw(self, label: str, count: int) -> np.ndarray:
        """``count`` numbers below 2 ** 32 that follow from the key and the label."""
        out = b"".join(hashlib.blake2b(f"{i}|{label}".encode(), key=self.key).digest() for i in range(count // 16 + 1))
        return np.frombuffer(out, "<u4")[:count]

    def letters(self, text: str, label: str) -> str:
        """Digits to digits and letters to letters of their script and case; the rest stays."""
        draws, out = self.draw(label, len(text)), []
        for c, r in zip(text, draws.tolist()):
            low = c.lower()
            if c.isdigit():
                c = str(r % 10)
            elif c.isalpha():
                abc = next((abc for a, b, abc in _SCRIPTS if a <= low <= b), None)
                if abc is None:
                    abc = _SCRIPTS[0][2] if low < "ɐ" else None
                if abc:
                    c = abc[r % len(abc)].upper() if c != low else abc[r % len(abc)]
                else:
                    c = chr((ord(c) & ~15) + r % 16) if chr((ord(c) & ~15) + r % 16).isalpha() else c
            out.append(c)
        return "".join(out)

    def make(self, kind: str, canon: str, turn: int) -> str:
        """Surrogate in canonical form; from the twelfth try on it grows, so that no format runs out."""
        label, longer = f"{kind}|{canon}|{turn}", max(0, turn - 11)
        if kind == "email":
            local, domain = canon.split("@", 1)
            labels = domain.split(".")
            host = self.letters(".".join(labels[:-1]), f"domain|{domain}")
            return f"{self.letters(local + 'a' * longer, label)}@{host}.{labels[-1]}"
        if kind == "secret":
            head = re.match(r"AKIA|ASIA|(?:sk|pk|ghp|gho|xox[bp])[-_]", canon)
            if head:
                return head[0] + self.letters(canon[head.end():], label)
            abc = "0123456789abcdef" if canon == canon.lower() else "0123456789ABCDEF"
            return "".join(abc[r % 16] for r in self.draw(label, len(canon)).tolist())
        if kind == "ip":
            return ".".join(str(1 + r % 254) for r in self.draw(label, 4).tolist())
        if kind == "card":
            body = canon[0] + self.letters(canon[1:], label)
            return body[:-1] + _check_digit(body[:-1]) if _check_digit(canon[:-1]) == canon[-1] else body
        if kind == "iban":
            body = self.letters(canon[4:], label)
            number = "".join(str(int(c, 36)) for c in body + canon[:2] + "00")
            return f"{canon[:2]}{98 - int(number) % 97:02d}{body}"
        if kind == "phone":
            keep = 1 if canon[0] == "1" else 2 if len(canon) > 10 else 0
            return canon[:keep] + self.letters(canon[keep:], label)
        if kind == "ssn":
            return self.letters(canon, label)
        return self.name(kind, canon, label, longer)

    def name(self, kind: str, canon: str, label: str, longer: int) -> str:
        """A name of syllables in the script of the real one, about as long; female given names end in the open vowel, male ones in a consonant."""
        first = canon[0]
        script = "а" if "а" <= first <= "я" else "α" if "α" <= first <= "ω" else "a"
        vowels, abc = _VOWELS[script], next(a for s, _, a in _SCRIPTS if s == script)
        consonants = [c for c in abc if c not in vowels and c not in "ьыэqxς"]
        size = max(4, len(canon)) + longer
        draws = self.draw(label, size).tolist()
        out = [(consonants if i % 2 == 0 else vowels)[r % (len(consonants) if i % 2 == 0 else len(vowels))] for i, r in enumerate(draws)]
        if kind == "given-f":
            out = out[:size - 1 if size % 2 else size] + ([] if size % 2 == 0 else [])
            out[-1] = vowels[0]
        elif kind == "given-m" and size % 2 == 0:
            out.append(consonants[draws[0] % len(consonants)])
        return "".join(out)


def _check_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def dress(kind: str, mention: str, surrogate: str) -> str:
    """A canonical surrogate with the separators and letter case of the mention."""
    if kind in ("card", "phone", "iban", "ssn"):
        left = iter(surrogate)
        return "".join(next(left, "") if c.isalnum() else c for c in mention) + "".join(left)
    if kind == "email":
        return "".join(s.upper() if i < len(mention) and mention[i].isupper() else s for i, s in enumerate(surrogate))
    if kind.startswith("given") or kind == "family":
        return surrogate.upper() if mention.isupper() and len(mention) > 1 else surrogate[:1].upper() + surrogate[1:]
    return surrogate


def _rows(batch: pa.RecordBatch):
    """Row number, text and entities (start, end, type, canonical form) of rows that have any."""
    held = pc.fill_null(pc.match_substring_regex(batch.column("text"), MAY_HOLD), False).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(held).tolist():
        text = batch.column("text")[i].as_py()
        found = entities(text)
        if found:
            yield i, text, found


def _class(kind):
    """Types whose surrogates must differ from each other: given names of all genders and family names are names."""
    return F.when(kind.startswith("given") | (kind == "family"), F.lit("name")).otherwise(kind)


def tries(docs: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """``kind``, ``canon``, ``turn`` of the entities that are past their first try."""
    def known_in(batches):
        for batch in batches:
            seen = {(k, c) for _, _, found in _rows(batch) for _, _, k, c in found}
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*seen)], names=["kind", "canon"])

    def make(batches):
        maker = Maker(key)
        for batch in batches:
            cols = batch.to_pydict()
            made = [maker.make(k, c, t) for k, c, t in zip(cols["kind"], cols["canon"], cols["turn"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "canon", "turn", "made"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    known = stage(texts.mapInArrow(known_in, "kind string, canon string").distinct(), "entities")
    real = known.select(_class(F.col("kind")).alias("class"), F.col("canon").alias("made")).distinct().withColumn("occurs", F.lit(True))
    now = stage(known.withColumn("turn", F.lit(0)).mapInArrow(make, "kind string, canon string, turn int, made string"), "surrogates")
    for _ in range(rounds):
        held = now.withColumn("class", _class(F.col("kind"))).join(real, ["class", "made"], "left")
        first = held.groupBy("class", "made").agg(F.min(F.struct("turn", "kind", "canon")).alias("first"), F.count("*").alias("m"))
        clash = (held.join(first.where("m > 1"), ["class", "made"], "left")
                 .withColumn("again", F.col("occurs").isNotNull() | (F.col("first").isNotNull() & (F.struct("turn", "kind", "canon") != F.col("first")))))
        state = stage(clash.select("kind", "canon", "turn", "made", "again"), "surrogates")
        if state.where("again").isEmpty():
            break
        moved = state.where("again").select("kind", "canon", (F.col("turn") + 1).alias("turn"))
        now = state.where("not again").select("kind", "canon", "turn", "made").unionByName(
            moved.mapInArrow(make, "kind string, canon string, turn int, made string"))
        now = stage(now, "surrogates")
    else:
        raise RuntimeError(f"surrogates still collide after {rounds} rounds")
    return now.where("turn > 0").select("kind", "canon", "turn")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``n_entities``, the number of mentions replaced.

    Null texts stay null with 0 mentions.  Rows that repeat are treated alike.  A name needs
    a title before it to be detected; its mentions without one in the same text are replaced too.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    late = stage(tries(docs, key), "late-entities")
    row = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    base = docs.select(*names, row.alias("__row")).withColumn("text", F.col("text").cast("string"))

    def mentions(batches):
        for batch in batches:
            rows = batch.column("__row")
            seen = {(rows[i].as_py(), k, c) for i, _, found in _rows(batch) for _, _, k, c in found}
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*seen), (pa.int64(), pa.string(), pa.string()))],
                                                 names=["__row", "kind", "canon"])

    where = (base.select("text", "__row").mapInArrow(mentions, "__row long, kind string, canon string").join(late, ["kind", "canon"])
             .distinct().groupBy("__row").agg(F.collect_list(F.struct("kind", "canon", "turn")).alias("__late")))
    where = stage(where, "late-rows")
    schema = docs.select(*names).schema

    def write(batches):
        maker = Maker(key)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                text, count = part.column("text"), np.zeros(part.num_rows, np.int64)
                later = part.column("__late") if "__late" in part.schema.names else None
                new = {}
                for i, own, found in _rows(part):
                    turns = {(x["kind"], x["canon"]): x["turn"] for x in (later[i].as_py() or [])} if later is not None else {}
                    out, last = [], 0
                    for s, e, kind, canon in found:
                        out += [own[last:s], dress(kind, own[s:e], maker.make(kind, canon, turns.get((kind, canon), 0)))]
                        last = e
                    new[i], count[i] = "".join(out) + own[last:], len(found)
                if new:
                    text = pa.array([new.get(i, t) for i, t in enumerate(text.to_pylist())], pa.string())
                cols = [text if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(count)], names=[*names, "n_entities"])

    # A bitmap of fixed size tells the few rows that have to meet entities past their first try; the others are not moved.
    slot = F.pmod(F.col("__row"), F.lit(SLOTS))
    bit = F.expr("shiftleft(1L, cast(__slot & 31 as int))")
    marks = (where.select(slot.alias("__slot")).select(F.shiftright("__slot", 5).alias("__word"), bit.alias("bit"))
             .groupBy("__word").agg(F.bit_or("bit").alias("__marks")))
    marked = (base.withColumn("__slot", slot).withColumn("__word", F.shiftright("__slot", 5)).join(F.broadcast(marks), "__word", "left")
              .withColumn("__again", F.coalesce(F.col("__marks").bitwiseAND(bit) != 0, F.lit(False))).select(*names, "__row", "__again"))
    out = copy.deepcopy(schema).add("n_entities", "long")
    plain = marked.where("not __again").select(*names).mapInArrow(write, out)
    held = marked.where("__again").join(where, "__row", "left").select(*names, "__late").mapInArrow(write, out)
    return plain.unionByName(held)
