r"""Quality rules, line first, as DataFrame expressions only.

Words are runs of characters other than space and U+0009..U+000D. A document fails the base rules with fewer
than MIN_WORDS words or with over MAX_REPEAT % of its words in repeated five-word windows. Else every line
with a word is judged. Punctuation: a symbol for every three words, LEAST_MARKS punctuation marks and
half as many as letters and digits, or an exclamation mark for each word in a line of capitals. Navigation: MENU_ITEMS
items of up to ITEM_WORDS words between separators, a line that is a menu word, or one of MENU_ITEMS + 1 or
more lines in a row (blank ones aside) of up to ITEM_WORDS words without end punctuation. Boilerplate: a stock
phrase of one of four languages in a line of up to PHRASE_CHARS characters. Failing lines are removed, and a document that keeps under MIN_KEPT % of its
word characters is rejected; the others go on without those lines. The thresholds are the module's constants.

Cases: null and empty texts have no words and fail; an empty table gives an empty result. All work is within a
row, so there is no shuffle, no group can be hot, ties cannot occur, and equal rows get equal results; a long
text costs n log n. quality_digests takes doc_id and text alone; keep_good and clean_lines keep all columns of
any name and change text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import SPACE

MIN_WORDS, MAX_REPEAT, MIN_KEPT, WIDTH = 10, 20, 50, 5
# Stock phrases and menu words in English, German, French and Spanish.
PHRASES = ["all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados", "cookie policy", "cookie-richtlinie", "politique de cookies", "política de cookies", "privacy policy", "datenschutzerklärung", "politique de confidentialité", "política de privacidad", "terms of use", "terms of service", "nutzungsbedingungen", "conditions d'utilisation", "términos de uso", "enable javascript", "javascript aktivieren", "activez javascript", "activar javascript", "click here", "hier klicken", "cliquez ici", "haga clic aquí", "sign up for", "licensed under the", "lizenziert unter", "sous licence", "bajo la licencia", "lorem ipsum"]
MENU_WORDS = ["home", "homepage", "home page", "menu", "main menu", "navigation", "sitemap", "site map", "search", "login", "log in", "logout", "log out", "sign in", "sign out", "sign up", "register", "my account", "cart", "checkout", "about", "about us", "contact", "contact us", "faq", "help", "next", "next page", "previous", "previous page", "back", "back to top", "skip to content", "skip to main content", "read more", "see more", "show more", "share", "share this"]
MENU_WORDS += ["startseite", "menü", "suche", "anmelden", "abmelden", "registrieren", "warenkorb", "über uns", "kontakt", "impressum", "hilfe", "weiter", "zurück", "nach oben", "mehr lesen", "teilen", "accueil", "rechercher", "connexion", "déconnexion", "s'inscrire", "panier", "à propos", "aide", "suivant", "précédent", "retour", "haut de page", "lire la suite", "partager", "inicio", "menú", "buscar", "iniciar sesión", "cerrar sesión", "registrarse", "carrito", "acerca de", "contacto", "ayuda", "siguiente", "anterior", "volver", "leer más", "compartir"]
MENU_ITEMS, ITEM_WORDS = 3, 3
#: Characters of a line that a stock phrase, or a menu word, condemns, at most; punctuation marks of a line that they condemn, at least.
PHRASE_CHARS, MENU_CHARS, LEAST_MARKS = 200, 40, 3


def _any_of(words: list[str]) -> str:
    return "(?iu)(" + "|".join(w.replace("'", ".") for w in words) + ")"


_BLANK = r"[\\x20\\x09-\\x0D]"
_SQL_SPACE = SPACE.replace("\\", "\\\\")
NOT_SYMBOL, NOT_UPPER, NOT_LETTER, SHOUT = "[^#*$%&|<>]+", r"\\P{Lu}+", r"\\P{L}+", "[^!]+"
NOT_MARK, NOT_ALNUM = r"[^\\p{P}\\p{S}]+", r"[^\\p{L}\\p{N}]+"
SEPARATOR = "[|·•›»→]|(?<=\\\\s)[/>](?=\\\\s)"
#: A 1 among MENU_ITEMS + 1 or more in a row.
IN_RUN = "|".join(f"(?<={'1' * k})1(?={'1' * (MENU_ITEMS - k)})" for k in range(MENU_ITEMS + 1))


def _long(text: str) -> str:
    """SQL: whether text has more than ITEM_WORDS words."""
    space, word = _SQL_SPACE, _SQL_SPACE.replace("[", "[^")
    # possessive, so that a long word is read once
    return f"{text} rlike '^{space.rstrip('+')}*+{f'{space}+'.join([f'{word}+'] * (ITEM_WORDS + 1))}'"


def in_menu(lines: str) -> str:
    """SQL: for each of lines, all with a word, '2' where it is one of a run of short lines."""
    short = f"not {_long('l')} and not l rlike '[.!?:;,…][\\\\p{{Pe}}\\\\p{{Pf}}\"]*\\\\s*$'"
    return f"split(regexp_replace(array_join(transform({lines}, l -> if({short}, '1', '0')), ''), '{IN_RUN}', '2'), '')"


def line_fails(line: str) -> str:
    """SQL: whether a line with a word is to be removed."""
    n = f"size(array_remove(split({line}, '{_SQL_SPACE}'), ''))"
    symbols = f"length(regexp_replace({line}, '{NOT_SYMBOL}', ''))"
    upper, letters = f"length(regexp_replace({line}, '{NOT_UPPER}', ''))", f"length(regexp_replace({line}, '{NOT_LETTER}', ''))"
    shouts = f"length(regexp_replace({line}, '{SHOUT}', ''))"
    marks, alnum = f"length(regexp_replace({line}, '{NOT_MARK}', ''))", f"length(regexp_replace({line}, '{NOT_ALNUM}', ''))"
    items = f"split({line}, '{SEPARATOR}', -1)"
    menu = f"({line} rlike '{SEPARATOR}' and size({items}) >= {MENU_ITEMS} and forall({items}, x -> not {_long('x')}))"
    listed = f"{line} rlike '^{_BLANK}*{_any_of(MENU_WORDS)}{_BLANK}*$'"
    stock = f"length({line}) <= {PHRASE_CHARS} and {line} rlike '{_any_of(PHRASES)}'"
    return f"(3 * {symbols} >= {n} or {marks} >= {LEAST_MARKS} and 2 * {marks} >= {alnum} or {shouts} >= {n} and 2 * {upper} >= {letters} or {stock} or length({line}) <= {MENU_CHARS} and {listed} or {menu})"


def measured(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_chars, kept."""
    names = [f"__k{i}" for i in range(len(keep))]
    ids = [F.col(n) for n in names]
    df = docs.select(*(c.alias(n) for c, n in zip(keep, names, strict=True)), F.coalesce(text, F.lit("")).alias("__t"))
    df = df.select(
        *ids,
        F.array_remove(F.split("__t", SPACE, -1), "").alias("__w"),
        F.expr(f"filter(split(__t, '\\n', -1), l -> l rlike '{_SQL_SPACE.replace('[', '[^').rstrip('+')}')").alias("__l"),
        F.length(F.regexp_replace("__t", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
    )
    df = df.select(*ids, "__l", "word_chars", "n_symbols", F.expr("transform(__w, w -> xxhash64(w))").alias("__h"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"))
    gram = ", ".join(f"get(__h, i + {k})" for k in range(WIDTH))
    df = df.select(*ids, "__l", "word_chars", "n_symbols", "n_dup_lines", F.size("__h").cast("long").alias("n_words"), F.expr(f"if(size(__h) < {WIDTH + 1}, cast(array() as array<bigint>), transform(sequence(0, size(__h) - {WIDTH}), i -> xxhash64({gram})))").alias("__g"))
    df = df.select(*ids, "__l", "word_chars", "n_symbols", "n_dup_lines", "n_words", F.expr("if(size(array_distinct(__g)) = size(__g), null, sort_array(transform(__g, (x, i) -> struct(x, i))))").alias("__z"))
    places = "sort_array(transform(filter(sequence(0, size(__z) - 1), k -> get(__z, k).x = get(__z, k - 1).x or get(__z, k).x = get(__z, k + 1).x), k -> get(__z, k).i))"
    covered = f"aggregate({places}, struct(0L as n, -{WIDTH}L as last), (a, p) -> struct(a.n + least({WIDTH}L, p - a.last) as n, cast(p as bigint) as last), a -> a.n)"
    df = df.select(*ids, "__l", "word_chars", "n_symbols", "n_dup_lines", "n_words", F.expr(f"if(__z is null, 0L, {covered})").alias("n_repeat_words"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    left = f"aggregate(zip_with(__l, {in_menu('__l')}, (l, m) -> if(l is null or m = '2' or {line_fails('l')}, 0L, length(regexp_replace(l, '{_SQL_SPACE}', '')))), 0L, (n, x) -> n + x)"
    df = df.withColumn("kept_chars", F.expr(f"if(base_failed, 0L, {left})"))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= MIN_KEPT * F.col("word_chars")))
    return df.select(*(c if isinstance(c, str) else c for c in ids), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


def quality_digests(docs: DataFrame) -> DataFrame:
    """Per document: the measures, the base verdict and the whole verdict."""
    return measured(docs, F.col("text"), [F.col("doc_id")]).withColumnRenamed("__k0", "doc_id")


def cleaned(text: str) -> str:
    """SQL: text without its failing lines; lines without a word stay."""
    bare = _SQL_SPACE.replace("[", "[^").rstrip("+")
    every = f"transform(split({text}, '\\n', -1), (l, i) -> struct(l, i))"
    worded = f"filter({every}, s -> s.l rlike '{bare}')"
    gone = f"filter(zip_with({worded}, {in_menu(f'transform({worded}, s -> s.l)')}, (s, m) -> if(m = '2' or {line_fails('s.l')}, s, null)), s -> s is not null)"
    return f"array_join(transform(array_except({every}, {gone}), s -> s.l), '\\n')"


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs with failing lines taken out of text."""
    return docs.withColumn("text", F.expr(cleaned("text")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines; other columns are unchanged."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    # the row number keeps the filter above: below, it would evaluate each measure within the next one's functions
    good = measured(docs, F.col("text"), [whole]).withColumn("__row", F.monotonically_increasing_id()).filter("kept and __row >= 0")
    text = F.when(F.col("kept_chars") == F.col("word_chars"), F.col("__k0.text")).otherwise(F.expr(cleaned("__k0.text"))).alias("text")
    return good.select(*(text if c == "text" else F.col(f"__k0.`{c}`") for c in docs.columns))
