"""Text functions as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters, digits and underscores of any script (Java's \\w knows ASCII only).
TOKEN = "[\\p{L}\\p{N}_]+"
#: What the answer filter rejects, in lower case.
COLLAPSED = "theanswer themaximum thedistrict thegovernor whatisthe underwhat whatarethe whathappens accordingto inthe ofthe tothe fromthe givingwritten nationalcommission statecommission districtcommission underthe ofreceive ofgoods orany intothe bythe withthe forthe onthe asthe shallbe canbe".split()
GARBAGE = ["ins.by", "subs.by", "w.e.f.", "act,1969", "act,1971", "fourthsch.", "eighthsch.", "________________"]
UNSUPPORTED = ["not explicitly stated", "not stated in the passage", "cannot be determined from the passage", "not provided in the passage", "information is not available", "not mentioned in the passage"]
VAGUE = ["such qualifications as may be prescribed", "such manner as may be prescribed", "as may be prescribed", "as prescribed", "provided in the relevant provision", "provided in the passage", "mentioned in the passage"]
#: Words that a question starts with, and questions that say nothing.
QUESTION_WORDS = ["what", "which", "who", "when", "where", "why", "how", "under what", "whether"]
GENERIC_QUESTIONS = [
    "answer the legal question using only the provided legal context.",
    "answer the legal question using only the provided context.",
    "answer the question using only the provided legal context.",
    "answer the question using only the provided context.",
]
#: Endings that a question's fingerprint drops.
FINGERPRINT_ENDS = ["with reference to the constitution of india\\.?$", "under the consumer protection act,?\\s*2019\\.?$", "under the act\\.?$", "under the constitution\\.?$"]
#: The follow-up questions that stand in for a model's.
FOLLOWUPS = ["What are the key exceptions under this provision?", "Which authority enforces these guidelines?", "What legal remedies are available for non-compliance?"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Tokens and keys -------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def squeezed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def words(text: Column) -> Column:
    """The words of a text; none for an empty one."""
    return F.filter(F.split(squeezed(text), " "), lambda w: w != "")


def space_key(text: Column) -> Column:
    return F.lower(squeezed(text))


def alnum_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def fingerprint(question: Column) -> Column:
    out = space_key(question)
    for end in FINGERPRINT_ENDS:
        out = F.regexp_replace(out, end, "")
    return F.trim(out)


def bare_words(text: Column) -> Column:
    """Lower-cased words without ASCII punctuation."""
    return words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[!-/:-@\\[-`{-~]", ""))


# Cleaning --------------------------------------------------------------------------------------


def cleaned(text: Column, repairs: Sequence[tuple[str, str]] = ()) -> Column:
    """Without NULs, no-break spaces, rules of underscores and surplus white space; then literal repairs."""
    out = F.regexp_replace(F.translate(text, "\u0000\u00a0", " "), "_{5,}", " ")
    out = squeezed(F.regexp_replace(out, "\u00a0", " "))
    for wrong, right in repairs:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def word_boundaries(text: Column) -> Column:
    """A blank between a small and a capital letter, and between letters and digits."""
    out = F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " ")
    out = F.regexp_replace(out, "(?<=[A-Za-z])(?=[0-9])", " ")
    return F.regexp_replace(out, "(?<=[0-9])(?=[A-Za-z])", " ")


# Splitting -------------------------------------------------------------------------------------


def sentences(text: Column, longer_than: int = 0) -> Column:
    """Trimmed parts between white space that follows a full stop, an exclamation or a question mark."""
    parts = F.transform(F.split(F.trim(text), "(?<=[.!?])\\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def dot_sentences(text: Column, longer_than: int = 15) -> Column:
    parts = F.transform(F.split(F.translate(text, "\n", " "), "\\."), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def word_windows(text: Column, size: int, least_chars: int = 0, least_words: int = 0) -> Column:
    """Array of struct(no, text): windows of `size` words."""

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.struct((i / size).cast("int").alias("no"), F.slice(w, i + 1, F.lit(size)).alias("w")))
        kept = F.filter(parts, lambda p: (F.size(p["w"]) >= least_words) & (F.length(F.array_join(p["w"], " ")) > least_chars))
        return F.transform(kept, lambda p: F.struct(p["no"].alias("no"), F.array_join(p["w"], " ").alias("text")))

    return let(words(text), cut)


def char_windows(text: Column, size: int = 1200, least: int = 150) -> Column:
    """Array of struct(no, text): trimmed windows of `size` characters of the squeezed text, with `least` or more."""

    def cut(t: Column) -> Column:
        starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.struct((i / size).cast("int").alias("no"), F.trim(F.substr(t, i + 1, F.lit(size))).alias("text")))
        return F.filter(parts, lambda p: F.length(p["text"]) >= least)

    return let(squeezed(text), cut)


def packed_sentences(text: Column, least: int = 80, most: int = 220) -> Column:
    """Sentences packed greedily into chunks of up to `most` words; chunks of under `least` are dropped."""
    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.array().cast("array<string>").alias("now"))

    def done(acc: Column) -> Column:
        return F.when(F.size(acc["now"]) >= least, F.array_append(acc["chunks"], F.array_join(acc["now"], " "))).otherwise(acc["chunks"])

    def step(acc: Column, w: Column) -> Column:
        fits = F.size(acc["now"]) + F.size(w) <= most
        return F.when(fits, F.struct(acc["chunks"].alias("chunks"), F.concat(acc["now"], w).alias("now"))).otherwise(F.struct(done(acc).alias("chunks"), w.alias("now")))

    parts = F.transform(F.split(text, "(?<=[.!?])\\s+"), words)
    return F.aggregate(parts, start, step, done)


# Extraction ------------------------------------------------------------------------------------


def nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def legal_reference(question: Column) -> Column:
    """struct(kind, number): the first Article, else the first Section; nulls for none."""
    article = nonempty(F.regexp_extract(question, "(?i)\\bArticle\\s+([0-9]+[A-Za-z]?)\\b", 1))
    section = nonempty(F.regexp_extract(question, "(?i)\\bSection\\s+([0-9]+[A-Za-z]?)\\b", 1))
    kind = F.when(article.isNotNull(), "article").when(section.isNotNull(), "section")
    return F.struct(kind.alias("kind"), F.coalesce(article, section).alias("number"))


def citation(text: Column, page: Column) -> Column:
    found = F.regexp_extract(text, "(?i)(Article\\s+\\d+|Art\\.\\s*\\d+|Section\\s+\\d+|Chapter\\s+[IVXLCDM\\d]+)", 1)
    return F.coalesce(nonempty(found), F.concat(F.lit("Page "), page.cast("string")))


def provision(text: Column, number: Column) -> Column:
    """From the line `number. Heading` up to the next numbered heading, trimmed; null if there is none."""
    head = F.concat(F.lit("(?m)^\\s*"), number, F.lit("\\.\\s+[A-Za-z]"))
    parts = F.split(text, "(?m)(?=^[^\\S\\n]*(?:\\d+|\\d+[A-Za-z])\\.\\s+[A-Za-z])")
    return F.trim(F.get(F.filter(parts, lambda p: F.regexp_like(p, head)), F.lit(0)))


def headings(text: Column) -> Column:
    """Array of struct(number, title) of numbered headings of over 10 characters."""
    pattern = "(?:^|\\n)\\s*(\\d+[A-Za-z]?)\\.\\s+([A-Z][^\\n]{10,})"
    group = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    return F.arrays_zip(group(1).alias("number"), F.transform(group(2), lambda t: F.substring(t, 1, 500)).alias("title"))


def qa_pairs(text: Column) -> Column:
    """Array of struct(q, a) of `Q: ... A: ...` pairs."""
    pattern = "(?s)Q:\\s*(.+?)\\s*A:\\s*(.+?)(?=Q:|$)"
    group = lambda i: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), lambda s: F.trim(F.regexp_replace(s, "^\\s+|\\s+$", "")))
    return F.arrays_zip(group(1).alias("q"), group(2).alias("a"))


def prompt_question(text: Column) -> Column:
    """What stands between `Question:` and `Legal evidence:`, else the text."""
    return F.coalesce(nonempty(F.trim(F.regexp_extract(text, "(?is)Question:\\s*(.*?)\\s*Legal evidence:", 1))), text)


def lenient_json(text: Column, schema: str) -> Column:
    """Parsed JSON: the text without code fences, else its part from the first brace to the last."""
    bare = F.regexp_replace(text, "```(?:json)?", "")
    whole = F.from_json(bare, schema, {"mode": "PERMISSIVE"})
    part = F.from_json(F.regexp_extract(bare, "(?s)\\{.*\\}", 0), schema)
    return F.when(F.try_parse_json(F.trim(bare)).isNotNull(), whole).otherwise(part)


def followups(text: Column) -> Column:
    """The first three lines without bullets and numbers; fixed questions for a null text."""
    lines = F.filter(F.split(F.trim(text), "\n"), lambda s: F.trim(s) != "")
    own = F.slice(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, "^[-• 1-9.]+|[-• 1-9.]+$", ""))), 1, 3)
    return F.coalesce(own, F.array(*map(F.lit, FOLLOWUPS)))


# Predicates ------------------------------------------------------------------------------------


def holds_any(text: Column, markers: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def bad_answer(answer: Column) -> Column:
    low, n = F.lower(answer), F.size(words(answer))
    return ((n < 4) & (F.length(answer) > 80)) | holds_any(low, COLLAPSED + GARBAGE + UNSUPPORTED) | (F.length(answer) > 1800) | (holds_any(low, VAGUE) & (n < 30))


def evidence_in(evidence: Column, passage: Column) -> Column:
    return F.contains(space_key(passage), space_key(evidence))


def references_supported(answer: Column, evidence: Column) -> Column:
    """Every legal reference of the answer stands in the evidence."""
    found = F.regexp_extract_all(answer, F.lit("(?i)\\b(?:Article|Part|Chapter|section|clause)\\s+[A-Za-z0-9]+(?:\\s+[A-Za-z0-9]+)?"), F.lit(0))
    return F.forall(found, lambda r: F.contains(F.lower(evidence), F.lower(r)))


def good_question(question: Column, least_words: int = 5) -> Column:
    low = F.lower(F.trim(question))
    starts = F.regexp_like(low, F.lit("^(" + "|".join(QUESTION_WORDS) + ")[ ?]"))
    return starts & ~low.isin(*GENERIC_QUESTIONS) & (F.length(question) >= 15) & (F.size(words(question)) >= least_words)


def lenient_bool(text: Column) -> Column:
    return F.coalesce(F.lower(text.cast("string")).isin("true", "1", "yes"), F.lit(False))


def lenient_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


# Assembly --------------------------------------------------------------------------------------


def context_block(no: Column, source: Column, cited: Column, page: Column, text: Column) -> Column:
    head = F.format_string("\n--- CONTEXT CHUNK %d [Source: %s | Citation: %s | Page: %s] ---\n", no, F.coalesce(source, F.lit("File")), F.coalesce(cited, F.lit("Unknown Document")), F.coalesce(page.cast("string"), F.lit("-")))
    return F.concat(head, text, F.lit("\n"))


def prompt(system: Column, history: Column, contexts: Column, question: Column) -> Column:
    past = F.when(history != "", F.concat(F.lit("CONVERSATION SO FAR:\n"), history)).otherwise("")
    return F.concat(system, F.lit("\n\n"), past, F.lit("\n"), contexts, F.lit("\n\nUSER QUESTION: "), question, F.lit("\n\nLEGAL ANSWER:"))


def instruction(question: Column, context: Column, answer: Column) -> Column:
    return F.concat(F.lit("### Instruction:\n"), question, F.lit("\n\n### Input:\n"), context, F.lit("\n\n### Response:\n"), answer)


def fit_to_budget(text: Column, fixed_words: Column, budget: int, tries: int = 30) -> Column:
    """The text cut to 0.85 of its characters until it and fixed_words fit the budget of words; null if it never does."""
    start = F.struct(text.alias("t"), F.lit(False).alias("ok"))

    def step(acc: Column, _: Column) -> Column:
        fits = fixed_words + F.size(words(acc["t"])) <= budget
        shorter = F.substr(acc["t"], F.lit(1), F.floor(F.length(acc["t"]) * 0.85).cast("int"))
        return F.when(acc["ok"] | fits, F.struct(acc["t"].alias("t"), F.lit(True).alias("ok"))).otherwise(F.struct(shorter.alias("t"), F.lit(False).alias("ok")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(tries)), start, step, lambda acc: F.when(acc["ok"], acc["t"]))


def label_title(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def band(value: Column, edges: Sequence[tuple[float, str]], last: str, descending: bool = False) -> Column:
    """The name of the first edge that the value lies below (or, descending, reaches), else last."""
    out = None
    for edge, name in edges:
        test = value >= edge if descending else value < edge
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)
