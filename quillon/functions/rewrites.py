"""Counterfactual rewrites of English texts as Column expressions: gender, name and age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import SPACE, strip

#: Gendered words and their counterparts (fixed values).
COUNTERPARTS = {
    "he": "she", "she": "he", "him": "her", "his": "her", "himself": "herself", "herself": "himself", "hers": "his",
    "man": "woman", "woman": "man", "men": "women", "women": "men", "father": "mother", "mother": "father",
    "husband": "wife", "wife": "husband", "son": "daughter", "daughter": "son", "brother": "sister", "sister": "brother",
    "mr": "ms", "ms": "mr", "mrs": "mr", "miss": "mr", "sir": "madam", "madam": "sir", "boy": "girl", "girl": "boy",
    "male": "female", "female": "male", "gentleman": "lady", "lady": "gentleman", "king": "queen", "queen": "king",
    "actor": "actress", "actress": "actor", "chairman": "chairwoman", "chairwoman": "chairman",
    "spokesman": "spokeswoman", "spokeswoman": "spokesman",
}
#: A gendered word as a whole run of letters; most runs begin with none of the letters that these begin with.
GENDERED = rf"(?<![A-Za-z])(?=[{''.join(sorted({c for w in COUNTERPARTS for c in (w[0], w[0].upper())}))}])(?i:{'|'.join(sorted({*COUNTERPARTS, 'her'}, key=lambda w: (w[0], -len(w), w)))})(?![A-Za-z])"
#: Words after which "her" is an object, not a possessive (fixed values).
OBJECT_FOLLOWERS = ("a", "an", "the", "this", "that", "these", "those", "to", "for", "with", "at", "in", "on", "of", "by", "from", "as", "and", "or", "but", "into", "about", "after", "before", "while", "when", "where", "who", "which", "if", "so", "up", "out", "over", "off")
#: Phrases that the swap leaves alone; years and durations that give an age away (fixed values).
PROTECTED = r"(?i)\b((?:wo)?men)('?s (?:health|medicine|hospital|clinic|center|centre)\b)"
YEAR, DURATION = r"\b(19[5-9][0-9]|20[0-2][0-9])\b", r"(?i)\b([0-9]{1,9})\+?\s+years?\b"
#: Given names by perceived group and gender from a published field experiment on hiring (fixed values).
NAMES = {
    ("white", "female"): ("Emily", "Anne", "Jill", "Allison", "Laurie", "Sarah", "Meredith", "Carrie", "Kristen"),
    ("white", "male"): ("Greg", "Brad", "Todd", "Brett", "Neil", "Geoffrey", "Matthew", "Jay", "Brendan"),
    ("black", "female"): ("Lakisha", "Latoya", "Tamika", "Keisha", "Ebony", "Aisha", "Kenya", "Latonya", "Tanisha"),
    ("black", "male"): ("Jamal", "Leroy", "Rasheed", "Kareem", "Tyrone", "Darnell", "Hakim", "Tremayne", "Jermaine"),
}
MARK = "\u0001"  # shields a protected word from the swap; texts that hold it keep it, since it is no letter
EDGE = r"[^\p{L}\p{N}_]"  # what is no part of a word, in any script
PRONOUN = rf"(\A|{EDGE})(He|She|he|she)(\z|{EDGE})"
SENTENCE_END = rf"[.!?][\"'”’)\]]?{SPACE}*\z"


def match_case(word: Column, like: Column) -> Column:
    """Upper-cased like a word of two or more capitals, capitalised like a capitalised one."""
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(word)).when(F.substring(like, 1, 1) == F.upper(F.substring(like, 1, 1)), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100))).otherwise(word)


def swap_gender(text: Column, protect: bool = True) -> Column:
    """struct(text, swapped, her_resolved): gendered words exchanged, case kept; "her" by what follows; phrases about men's and
    women's medicine left alone if `protect`. Without it no word is shielded, marks are characters like others, and white space is
    what SQL's patterns call so. A null text gives nulls."""
    # a protected word stands between marks
    shielded = F.regexp_replace(text, PROTECTED, f"{MARK}$1{MARK}$2") if protect else text
    white = r"^\s+\z" if protect else r"^[ \t\n\f\r]+\z"
    table = F.create_map(*[F.lit(x) for pair in COUNTERPARTS.items() for x in pair])

    def swapped(words: Column, gaps: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before, after = F.get(gaps, i), F.get(gaps, i + 1)
            shield = before.endswith(MARK) & after.startswith(MARK) if protect else F.lit(False)
            letters = F.regexp_extract(after, "^[^A-Za-z]*+([A-Za-z]+)", 1)
            follower = F.lower(F.when(letters != "", letters).otherwise(F.coalesce(F.get(words, i + 1), F.lit(""))))
            possessive = F.regexp_extract(after, "^[^A-Za-z]*+", 0).rlike(white) & (follower != "") & ~follower.isin(*OBJECT_FOLLOWERS)
            her = F.lower(t) == "her"
            other = F.when(shield, None).when(her, F.when(possessive, "his").otherwise("him")).otherwise(F.try_element_at(table, F.lower(t)))
            changed = lambda o: F.struct(F.concat(F.coalesce(match_case(o, t), t), after).alias("t"), o.isNotNull().cast("int").alias("s"), (o.isNotNull() & her).cast("int").alias("h"))
            return F.transform(F.array(other), changed)[0]

        return F.struct(F.get(gaps, F.lit(0)).alias("first"), F.transform(words, one).alias("rest"))

    def gathered(done: Column) -> Column:
        total = lambda field: F.aggregate(done["rest"], F.lit(0), lambda a, x: a + x[field])
        joined = F.concat(done["first"], F.array_join(F.transform(done["rest"], lambda x: x["t"]), ""))
        return F.struct((F.regexp_replace(joined, MARK, "") if protect else joined).alias("text"), total("s").alias("swapped"), total("h").alias("her_resolved"))

    # only gendered words, few of all, become tokens, with what stands between them; arrays of one bind a value to a variable: written
    # out, each token would split the text anew
    parts = F.transform(F.array(shielded), lambda x: F.struct(F.regexp_extract_all(x, F.lit(GENDERED), F.lit(0)).alias("words"), F.split(x, GENDERED).alias("gaps")))
    done = F.transform(parts, lambda x: swapped(x["words"], x["gaps"]))
    return F.when(text.isNotNull(), F.transform(done, gathered)[0])


def pronoun_at(text: Column) -> Column:
    """1-based place of the first he or she as a word; 0 without one."""
    first = F.regexp_instr(text, F.lit(PRONOUN))
    lead = F.regexp_extract(text, PRONOUN, 1)
    return F.when(first > 0, first + F.length(lead)).otherwise(0)


def pronoun(text: Column) -> Column:
    return F.regexp_extract(text, PRONOUN, 2)


def insert_name(text: Column, name: Column) -> Column:
    """The first subject pronoun replaced by the name; null without one."""
    at = pronoun_at(text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), name, F.substring(text, at + F.length(pronoun(text)), F.length(text))))


def around_pronoun(text: Column) -> Column:
    """struct(before, pronoun, after, opens) of the first subject pronoun; opens says whether it opens a sentence; null without one.
    Arrays of one bind the place and the parts, so that the text is searched once."""

    def cut(at: Column) -> Column:
        rest = F.substring(text, at, F.length(text))
        found = F.when(F.lower(F.substring(rest, 1, 3)) == "she", F.substring(rest, 1, 3)).otherwise(F.substring(rest, 1, 2))
        return F.struct(F.substring(text, F.lit(1), at - 1).alias("before"), found.alias("pronoun"), F.substring(rest, F.length(found) + 1, F.length(text)).alias("after"))

    def judged(x: Column) -> Column:
        opens = (strip(x["before"]) == "") | x["before"].rlike(SENTENCE_END)
        return F.struct(x["before"].alias("before"), x["pronoun"].alias("pronoun"), x["after"].alias("after"), opens.alias("opens"))

    places = F.filter(F.array(pronoun_at(text)), lambda at: at > 0)
    return F.get(F.transform(F.transform(places, cut), judged), F.lit(0))


def with_age(parts: Column, age: Column) -> Column:
    """struct(text, case) from what is around the pronoun."""
    initial = F.concat(parts["before"], F.lit("At "), age.cast("string"), F.lit(", "), F.lower(parts["pronoun"]), parts["after"])
    middle = F.concat(F.regexp_replace(parts["before"], rf"{SPACE}+\z", ""), F.lit(", at "), age.cast("string"), F.lit(", "), parts["pronoun"], parts["after"])
    return F.when(parts.isNotNull(), F.struct(F.when(parts["opens"], initial).otherwise(middle).alias("text"), F.when(parts["opens"], "sentence_initial").otherwise("mid_sentence").alias("case")))


def insert_age(text: Column, age: Column) -> Column:
    """struct(text, case): ", at {age}," before the first subject pronoun, or "At {age}, " where it opens a sentence; null
    without a pronoun."""
    return with_age(around_pronoun(text), age)


def eligible_for_age(text: Column) -> Column:
    """Has a subject pronoun, no year from 1950 to 1999, no duration of ten or more years."""
    years = F.regexp_extract_all(text, F.lit(YEAR), 1)
    spans = F.regexp_extract_all(text, F.lit(DURATION), 1)
    return (pronoun_at(text) > 0) & ~F.exists(years, lambda y: y.cast("int") < 2000) & ~F.exists(spans, lambda y: y.cast("int") >= 10)


def pick_name(group: str, gender: Column, draw: Column) -> Column:
    """One of the group's names by a draw from [0, 1)."""
    pools = {g: F.array(*[F.lit(n) for n in NAMES[group, g]]) for g in ("female", "male")}
    at = lambda pool: F.element_at(pool, (F.floor(draw * F.size(pool)) + 1).cast("int"))
    return F.when(gender == "female", at(pools["female"])).otherwise(at(pools["male"]))


def whole_words(words: Sequence[str]) -> str:
    """A pattern for any of the words as a whole word, in any script."""
    return r"(?<![\p{L}\p{N}_])(?:" + "|".join(sorted(words)) + r")(?![\p{L}\p{N}_])"


def redact_names(text: Column, names: Sequence[str]) -> Column:
    """struct(text, redacted): every capitalised word of the list becomes [name], counted. By the list alone: no entity recogniser is at
    hand, so a listed word that is no name here goes too. Null gives nulls."""
    pattern = whole_words(names)
    return F.when(text.isNotNull(), F.struct(F.regexp_replace(text, pattern, "[name]").alias("text"), F.regexp_count(text, F.lit(pattern)).alias("redacted")))


def with_full_name(text: Column, first: str | Column, last: str | Column, surnames: Sequence[str]) -> Column:
    """struct(text, pronoun, placeholders, surnames): the first subject pronoun as first and last name, every [name] as the first name,
    every listed surname as the last. text is null without any of these; a surname that is also a pronoun stays a pronoun. The text is
    searched once: arrays of one bind it and its parts."""
    first, last = (F.lit(x) if isinstance(x, str) else x for x in (first, last))
    listed = [s for s in surnames if s.lower() not in ("he", "she")]
    pattern = whole_words(listed) if listed else r"(?!)"
    bare = F.replace(text, F.lit("[name]"), F.lit(""))

    def made(n: Column) -> Column:
        filled = F.replace(F.regexp_replace(text, F.lit(pattern), last) if listed else text, F.lit("[name]"), first)
        named = F.transform(F.array(filled), lambda t: F.coalesce(F.get(F.transform(F.array(around_pronoun(t)), lambda p: F.concat(p["before"], first, F.lit(" "), last, p["after"])), F.lit(0)), t))[0]
        return F.struct(F.when(n["pronoun"] | (n["placeholders"] > 0) | (n["surnames"] > 0), named).alias("text"), n["pronoun"].alias("pronoun"), n["placeholders"].alias("placeholders"), n["surnames"].alias("surnames"))

    found = F.struct((pronoun_at(text) > 0).alias("pronoun"), ((F.length(text) - F.length(bare)) / 6).cast("int").alias("placeholders"), F.regexp_count(text, F.lit(pattern)).alias("surnames"))
    return F.when(text.isNotNull(), F.transform(F.array(found), made)[0])
