"""Personal data by weak supervision, with DataFrame functions only.

Base spans (e-mail addresses, IP addresses, payment cards, phone numbers) come from patterns and checks and
always stay. Further spans are found among candidates: words that hold a digit or an ``@``, assignments, words after a
naming context and hits of a gazetteer of names and places, which do not overlap a base span. Labelers vote on each candidate: patterns (assignments, key ids, hex strings, national
numbers), gazetteers (names and places speak for, words of versions, licences and counts against), and the words before it. A
labeler votes one way or abstains. Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability and the share of personal data; its posteriors are soft labels that train the final
span classifier (log odds of the votes, the candidate's shape and the word before it, each in a bounded number of
buckets). A candidate with odds above one becomes a span of kind ``secret``.

What reaches the driver are counts by (votes, shape, word before): at most 2**11 * 64 * 64 rows at any input
size. They are gathered over all documents. Texts are read twice, nothing else is shuffled, and no Python
runs on the executors.

Matches are leftmost and do not overlap within a kind. Patterns are anchored at the start of a run of their
characters and loop possessively, so that long runs take linear time and no deep recursion; both forms
match the same strings.

Defined results: null and empty texts have no spans; offsets count code points, ends are exclusive; each row
is on its own, so repeated rows and null ids are kept; without candidates there are no added spans; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh

KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"
# The base kinds' patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Gazetteer of given names and places.
GIVEN = "Ahmed|Alice|Ana|Andrea|Anna|Anne|Carlos|Charles|David|Elena|Elizabeth|Emma|Fatima|Francesca|Giovanni|Hans|Ivan|James|Jean|Jennifer|John|Jose|Joseph|Juan|Julia|Karen|Klaus|Laura|Linda|Luis|Marie|Maria|Mary|Michael|Mohammed|Patricia|Paul|Peter|Pierre|Richard|Robert|Sarah|Sofia|Susan|Thomas|William"
PLACES = "Amsterdam|Barcelona|Berlin|Boston|Brussels|Chicago|Dublin|Hamburg|Lisbon|London|Lyon|Madrid|Marseille|Milan|Munich|Paris|Rome|Seattle|Sydney|Tokyo|Toronto|Vienna|Zurich"
ASSIGNED = "pass(?:word|wd)?|pwd|secret|token|api[_-]?key|auth"
NAMED = "password|passwd|pwd|secret|token|api[ _-]?key|ssn|iban|passport|licen[cs]e no|account"
#: Words with a digit or an @, assignments, and gazetteer hits (a name with the capitalised word after it).
WORD = rf"(?<!\S)(?:[^\s0-9@]*+[0-9@]\S*+|[\"'(\[{{<]*+(?:(?i:{ASSIGNED})[=:]\S{{6,}}+|(?=\p{{Lu}})(?:(?:{GIVEN})(?![\p{{L}}0-9])(?:\x20\p{{Lu}}\p{{L}}++)?|(?:{PLACES})(?![\p{{L}}0-9]))))"
#: The same and words after a naming context; for texts that have one, as looking back takes time.
WORD_OR_NAMED = rf"(?:{WORD}|(?<!\S)(?<=(?i:\b(?:{NAMED})(?:\W{{0,3}}[=:]\W{{0,3}}|\W{{1,3}}(?:is|no|number)\W{{1,3}})))\S{{4,}}+)"
HAS_NAMED = rf"(?i:\b(?:{NAMED})(?:\W{{0,3}}[=:]|\W{{1,3}}(?:is|no|number)\W))"

EMPTY = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Buckets of shapes and of words before a candidate.
SHAPES = WORDS_BEFORE = 64
ROUNDS = 50
#: What covers base spans while candidates are looked for; Unicode has no such character.
COVER = "\ufdd0"
#: Characters before a candidate that labelers see, and matches whose offsets are summed together.
BEFORE = 32
CHUNK = 64

Labeler = tuple[str, int, str]
#: Name, vote (1: personal, 0: not), and SQL over ``word`` (a candidate) and ``before`` (the text before it).
LABELERS: tuple[Labeler, ...] = (
    ("assignment", 1, r"word RLIKE '(?i)^(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|auth)[=:].{6,}'"),
    ("key_id", 1, r"word RLIKE '^(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z_-]{16,}|xox[abp]-[0-9A-Za-z-]{10,})$'"),
    ("hex", 1, r"word RLIKE '^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{16,}$'"),
    ("national_number", 1, r"word RLIKE '^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30})$'"),
    ("address_like", 1, r"word RLIKE '^[^@]+@[^@]+$'"),
    ("mixed", 1, r"char_length(word) >= 12 AND char_length(regexp_replace(word, '[^0-9]', '')) >= 4 AND char_length(regexp_replace(word, '[^A-Za-z]', '')) >= 4"),
    ("named_before", 1, r"before RLIKE '(?i)\\b(?:password|passwd|pwd|secret|token|api[ _-]?key|ssn|iban|passport|licen[cs]e no|account)\\W{0,4}(?:is|no|number)?\\W{0,4}$'"),
    ("gazetteer_hit", 1, rf"word RLIKE '^(?:(?:{GIVEN})(?: [A-Z]|$)|(?:{PLACES})$)'"),
    ("plain_word", 0, r"word RLIKE '^[a-z]{1,7}$'"),
    ("short_number", 0, r"word RLIKE '^[0-9]{1,4}(?:[.,:/-][0-9]{1,4}){0,2}$'"),
    ("gazetteer", 0, r"lower(regexp_extract(before, '([A-Za-z]+)\\W*$', 1)) IN ('version','v','vol','volume','no','nr','page','pages','chapter','section','figure','table','nc','by','sa','cc','apache','gpl','mit','bsd','license','copyright','year','in','since') OR lower(regexp_replace(word, '[^A-Za-z]', '')) IN ('v','st','nd','rd','th','pp','km','kg','cm','mm','px','am','pm')"),
)


def _bound(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as (at, m, before), ``before`` being the last of what lies before the match.

    Offsets are running sums, taken within chunks of ``CHUNK`` matches after the sums of whole chunks, as an
    accumulator that holds an array is copied at each step.
    """
    kind = "array<struct<at:int,m:string,before:string>>"
    # there is one more piece between than matches, and its match is null
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, b: F.struct(m.alias("m"), F.char_length(b).alias("gap"), (F.char_length(b) + F.char_length(m)).alias("all"), F.right(b, F.lit(BEFORE)).alias("before")))

    def step(acc: Column, x: Column) -> Column:
        item = F.struct((acc.at + x.gap).alias("at"), x.m.alias("m"), x.before.alias("before"))
        return F.struct((acc.at + x["all"]).alias("at"), F.concat(acc.out, F.array(item)).alias("out"))

    def of_chunks(chunks: Column) -> Column:
        size = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["all"])
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(chunks, none, lambda acc, c: F.struct((acc.at + size(c)).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)
        begin = lambda o: F.struct(o.alias("at"), F.array().cast(kind).alias("out"))
        return F.flatten(F.zip_with(chunks, starts, lambda c, o: F.aggregate(c, begin(o), step, lambda acc: acc.out)))

    def of_matches(z: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda c: F.slice(z, c * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(z) > 0, _bound(chunks, of_chunks)).otherwise(F.array().cast(kind))

    return _bound(F.filter(pairs, lambda x: x.m.isNotNull()), of_matches)


def _found(text: Column, pattern: str, has: Column, rank: int, kind: str, valid) -> Column:
    """The valid matches of ``pattern`` as (start, rank, end, kind)."""
    span = lambda x: F.struct(x.at.alias("start"), F.lit(rank).alias("rank"), (x.at + F.char_length(x.m)).alias("end"), F.lit(kind).alias("kind"))
    return F.when(has, F.transform(F.filter(_placed(text, pattern), lambda x: valid(x.m)), span)).otherwise(F.array().cast(EMPTY))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(m)), ""), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid_card(m: Column) -> Column:
    n = F.char_length(_digits(m))
    return F.when((n >= 14) & (n <= 19), _luhn(m)).otherwise(F.lit(False))


def _valid_ip(m: Column) -> Column:
    return F.forall(F.split(m, "\\."), lambda p: F.char_length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(F.split(m, "\\."), lambda p: F.right(p, F.lit(9)).cast("int") <= 255)


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start and then kind."""
    email = _found(text, EMAIL, F.contains(text, F.lit("@")), 0, "email", lambda m: F.lit(True))
    ip = _found(text, IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), 1, "ip", _valid_ip)
    card = _found(text, CARD, F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}")), 2, "card", _valid_card)
    phone = _found(text, PHONE, F.contains(text, F.lit("+")), 3, "phone", lambda m: F.char_length(_digits(m)).between(10, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def _cuts(spans: Column) -> Column:
    """Of sorted spans the parts of the text to keep and what is written behind each, as (at, to, mark), and the end of all as a last part.

    A span that starts before the end of an earlier one has no mark of its own. The furthest end is carried along within chunks of
    ``CHUNK`` spans, after the ends of whole chunks, as an accumulator that holds an array is copied at each step.
    """
    kind = "array<struct<at:int,to:int,mark:string>>"

    def step(acc: Column, s: Column) -> Column:
        item = F.array(F.struct(acc.at.alias("at"), s.start.alias("to"), F.concat(F.lit("["), F.upper(s.kind), F.lit("]")).alias("mark")))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, F.concat(acc.out, item)).otherwise(acc.out).alias("out"))

    def of_chunks(chunks: Column) -> Column:
        ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s.end)))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(ends, none, lambda acc, e: F.struct(F.greatest(acc.at, e).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)
        begin = lambda at: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, begin(at), step, lambda acc: acc.out)))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda c: F.slice(spans, c * CHUNK + 1, F.lit(CHUNK)))
    return _bound(chunks, of_chunks)


def _replaced(text: Column, spans: Column, mark) -> Column:
    """``text`` with its sorted spans replaced by ``mark`` of a part (of ``_cuts``) and the end of what is replaced.

    Finding a place in a text takes a walk from its start, so texts of many spans are cut from an array of their characters.
    """

    def written(parts: Column) -> Column:
        end = F.array_max(F.transform(spans, lambda s: s.end))
        ends = F.concat(F.slice(F.transform(parts, lambda p: p["at"]), F.lit(2), F.size(parts)), F.array(end))

        def joined(piece) -> Column:
            return F.array_join(F.zip_with(parts, ends, lambda p, e: F.concat(piece(p), mark(p, e))), "")

        few = F.concat(joined(lambda p: F.substring(text, p["at"] + 1, p.to - p["at"])), F.substring(text, end + 1, F.char_length(text)))

        def of_many(letters: Column) -> Column:
            tail = F.array_join(F.slice(letters, end + 1, F.greatest(F.size(letters) - end, F.lit(0))), "")
            return F.concat(joined(lambda p: F.array_join(F.slice(letters, p["at"] + 1, p.to - p["at"]), "")), tail)

        return F.when(F.size(parts) <= CHUNK, few).otherwise(_bound(F.split(text, ""), of_many))

    return F.when(F.size(spans) == 0, text).otherwise(_bound(_cuts(spans), written))


def candidates(text: Column, base: Column) -> Column:
    """Candidate words outside the base spans as (start, end, word, before).

    They are looked for in the text with its base spans covered by a noncharacter, so a word that has one meets a base span.
    """
    kind = "array<struct<start:int,end:int,word:string,before:string>>"

    def trimmed(x: Column) -> Column:
        tail = F.regexp_replace(x.m, "^[\"'(\\[{<]+", "")
        word = F.regexp_replace(tail, "[\"')\\]}>.,;:!?#%*&]+$", "")
        start = x.at + F.char_length(x.m) - F.char_length(tail)
        return F.struct(start.alias("start"), (start + F.char_length(word)).alias("end"), word.alias("word"), x.before.alias("before"))

    def of(covered: Column) -> Column:
        free = lambda c: (c.word != "") & ~F.contains(c.word, F.lit(COVER))
        found = lambda pattern: F.filter(F.transform(_placed(covered, pattern), trimmed), free)
        return F.when(F.regexp_like(covered, F.lit(HAS_NAMED)), found(WORD_OR_NAMED)).when(F.regexp_like(covered, F.lit(WORD)), found(WORD)).otherwise(F.array().cast(kind))

    return _bound(_replaced(text, base, lambda p, e: F.repeat(F.lit(COVER), e - p.to)), of)


def _on(sql: str, item: str) -> str:
    return sql.replace("before", f"{item}.before").replace("word", f"{item}.word") if item else sql


def _labeler_sql(sql: str, item: str) -> str:
    """The labeler's SQL with the names ``word`` and ``before`` outside quotes bound to ``item``."""
    parts = sql.split("'")
    parts[::2] = [_on(p, item) for p in parts[::2]]
    return "(" + "'".join(parts) + ")"


def votes_sql(item: str) -> str:
    """The votes as one number, a bit for each labeler that does not abstain."""
    return " + ".join(f"if({_labeler_sql(sql, item)}, {1 << i}, 0)" for i, (_, _, sql) in enumerate(LABELERS))


def shape_sql(item: str) -> str:
    shape = f"regexp_replace(regexp_replace(regexp_replace({item}.word, '[A-Z]+', 'A'), '[a-z]+', 'a'), '[0-9]+', '9')"
    return f"pmod(xxhash64({shape}), {SHAPES})"


def before_sql(item: str) -> str:
    return f"pmod(xxhash64(lower(regexp_extract({item}.before, '([A-Za-z]+)\\\\W*$', 1))), {WORDS_BEFORE})"


@dataclass
class Model:
    """Reliabilities found by expectation-maximisation, and the classifier's log odds."""

    prior: float
    reliability: list[float]
    bias: float
    votes: list[float]
    shapes: list[float]
    before: list[float]

    def odds_sql(self, item: str) -> str:
        array = lambda xs: "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"
        votes = " + ".join(f"if({_labeler_sql(sql, item)}, {w!r}D, 0D)" for (_, _, sql), w in zip(LABELERS, self.votes, strict=True))
        return f"({self.bias!r}D + {votes} + element_at({array(self.shapes)}, cast({shape_sql(item)} AS int) + 1) + element_at({array(self.before)}, cast({before_sql(item)} AS int) + 1))"


def learn(counts: list[tuple[int, int, int, int]]) -> Model:
    """From (votes, shape, before, n): reliabilities by expectation-maximisation, then the classifier."""
    patterns: dict[int, float] = {}
    for v, _, _, n in counts:
        patterns[v] = patterns.get(v, 0.0) + n
    prior, trust = 0.3, [0.8] * len(LABELERS)
    posterior: dict[int, float] = {}
    for _ in range(ROUNDS):
        for v in patterns:
            # trust is the share of right votes, so the prior is for what has no vote
            yes, no = (0.0, 0.0) if v else (math.log(prior), math.log(1 - prior))
            for i, (_, side, _) in enumerate(LABELERS):
                if v >> i & 1:
                    yes += math.log(trust[i] if side else 1 - trust[i])
                    no += math.log(1 - trust[i] if side else trust[i])
            posterior[v] = 1 / (1 + math.exp(no - yes))
        total = sum(patterns.values())
        prior = min(0.95, max(0.05, sum(n * posterior[v] for v, n in patterns.items()) / max(total, 1.0))) if total else prior
        for i, (_, side, _) in enumerate(LABELERS):
            right = sum(n * (posterior[v] if side else 1 - posterior[v]) for v, n in patterns.items() if v >> i & 1)
            cast = sum(n for v, n in patterns.items() if v >> i & 1)
            trust[i] = min(0.99, max(0.55, (right + 8.0) / (cast + 10.0)))  # a labeler is better than chance
    yes, no = 1.0, 1.0
    tables = [([1.0] * size, [1.0] * size) for size in (len(LABELERS), SHAPES, WORDS_BEFORE)]
    for v, s, b, n in counts:
        p = posterior[v]
        yes, no = yes + n * p, no + n * (1 - p)
        for (plus, minus), buckets in zip(tables, ([i for i in range(len(LABELERS)) if v >> i & 1], [s], [b]), strict=True):
            for k in buckets:
                plus[k] += n * p
                minus[k] += n * (1 - p)
    bias = math.log(yes / no)
    vote_odds, *rest = [[math.log(a / c) - bias for a, c in zip(plus, minus, strict=True)] for plus, minus in tables]
    # shape and context refine the votes; labels have come from the votes, so these count half
    return Model(prior, trust, bias, vote_odds, *[[max(-2.0, min(2.0, x / 2)) for x in odds] for odds in rest])


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all candidates of all documents."""
    read = docs.select(_text(docs, text_col).alias("t")).withColumn("base", base_spans(F.col("t")))
    own = read.select(F.explode(candidates(F.col("t"), F.col("base"))).alias("c"))
    counts = own.groupBy(F.expr(votes_sql("c")).alias("v"), F.expr(shape_sql("c")).alias("s"), F.expr(before_sql("c")).alias("b")).agg(F.count("*").alias("n"))
    return learn([tuple(int(x) for x in r) for r in counts.collect()])


def with_spans(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """``docs`` with two columns of the given names, the base spans and all spans: arrays of (start, rank, end, kind)."""
    base, spans = names
    own, words = fresh(docs, "pii_text", "pii_words")
    read = docs.withColumn(own, _text(docs, text_col)).withColumn(base, base_spans(F.col(own))).withColumn(words, candidates(F.col(own), F.col(base)))
    added = F.expr(f"transform(filter(`{words}`, c -> {model.odds_sql('c')} > 0), c -> struct(c.start AS start, {len(KINDS)} AS rank, c.end AS end, '{ADDED}' AS kind))")
    return read.withColumn(spans, F.array_sort(F.concat(base, added))).drop(own, words)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row."""
    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    names = tuple(fresh(own, "base", "spans"))
    base, spans = names
    found = with_spans(own, train(own), "text", names)
    of_kind = lambda kind: F.filter(base, lambda s: s.kind == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(id_col), *counts, F.sha2(_written(F.col(base)).cast("binary"), 256).alias("base_sha256"), _written(F.col(spans)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each of its sorted spans replaced by its kind in brackets."""
    return _replaced(text, spans, lambda p, _: p.mark)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; null texts stay null."""
    names = tuple(fresh(docs, "pii_base", "pii_spans"))
    found = with_spans(docs, train(docs, text_col), text_col, names)
    clean = F.when(F.size(names[1]) == 0, F.col(text_col)).otherwise(redacted(_text(found, text_col), F.col(names[1])))
    return found.withColumn(text_col, clean).drop(*names)
