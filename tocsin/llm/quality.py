"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import per_row, table, words_space

SYMBOLS = b"#*$%&|<>"
#: Phrases that mark a line as boilerplate, in lower case: English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "accept cookies",
    "enable javascript", "lorem ipsum", "click here", "read more", "sign up", "log in", "subscribe to", "share this", "back to top",
    "skip to content", "add to cart", "powered by",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum", "verwendet cookies", "cookies akzeptieren", "javascript aktivieren",
    "hier klicken", "mehr lesen", "weiterlesen", "jetzt anmelden", "newsletter abonnieren", "nach oben", "zum inhalt springen", "in den warenkorb",
    "tous droits réservés", "conditions d'utilisation", "mentions légales", "politique de confidentialité", "utilise des cookies", "accepter les cookies", "activer javascript",
    "cliquez ici", "lire la suite", "se connecter", "s'inscrire", "abonnez-vous", "retour en haut", "aller au contenu", "ajouter au panier",
    "todos los derechos reservados", "condiciones de uso", "aviso legal", "política de privacidad", "utiliza cookies", "aceptar cookies", "habilitar javascript",
    "haga clic aquí", "leer más", "iniciar sesión", "regístrate", "suscríbete", "volver arriba", "saltar al contenido", "añadir al carrito",
)
#: Characters that part the entries of menus and tables, standing alone as words, once or up to three times.
SEPARATORS = "|/\\>»›<«‹-–—*•·:~_+→"
SEPARATOR_WORDS = frozenset((c * n).encode() for c in SEPARATORS for n in (1, 2, 3))
#: What a finished line ends with, and the quotes and brackets that may follow it.
TERMINAL, CLOSING = ".!?:;…。！？", "\"'”’»)]"
ENDS = tuple(c.encode() for c in TERMINAL)
CLOSERS = tuple(c.encode() for c in CLOSING)
#: Entries of menus, in lower case, in the same languages.
MENU = (
    "home about news contact help login logout register cart checkout search menu sitemap faq blog shop account profile careers press sports weather "
    "startseite aktuelles kontakt hilfe anmelden registrieren warenkorb suche impressum datenschutz produkte "
    "accueil actualités contact aide connexion panier recherche boutique plan compte "
    "inicio noticias contacto ayuda entrar carrito buscar tienda cuenta"
).split()
#: Every byte that is no letter, digit or part of a longer character to a space.
SPLIT_TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: The phrases as words, by their first.
PHRASES: dict[bytes, list[tuple[bytes, ...]]] = {}
for _phrase in BOILERPLATE:
    _words = tuple(_phrase.encode().translate(SPLIT_TABLE).split())
    PHRASES.setdefault(_words[0], []).append(_words)
MENU_WORDS = frozenset(w.encode() for w in MENU)
UPPER_TABLE = bytes(range(65, 91))
LETTERS_TABLE = bytes([*range(65, 91), *range(97, 123)])


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of what a document may lose."""

    max_symbol_share: float = 0.05  # symbol characters in a line's bytes
    max_separator_share: float = 0.2  # words that are only separators, from two on: menus and tables
    max_upper_share: float = 0.8  # of ASCII letters, in lines of three words or more
    max_boilerplate_share: float = 0.3  # of a line's words, that are words of boilerplate phrases
    max_menu_share: float = 0.6  # of a line's words, from three on, that are entries of menus
    max_lost_share: float = 0.5  # words lost with failing lines
    min_kept_words: int = 10


def line_fault(line: bytes, words: list[bytes], rules: LineRules) -> str:
    """The first rule that a line with words breaks; empty if it is clean."""
    separators = sum(map(SEPARATOR_WORDS.__contains__, words))
    if separators > max(1, rules.max_separator_share * len(words)):
        return "navigation"
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols > max(1, rules.max_symbol_share * len(line)):
        return "symbols"
    if len(words) >= 3:
        letters = len(line) - len(line.translate(None, LETTERS_TABLE))
        if letters and len(line) - len(line.translate(None, UPPER_TABLE)) > rules.max_upper_share * letters:
            return "capitals"
    plain = line.lower().translate(SPLIT_TABLE).split()
    if not PHRASES.keys().isdisjoint(plain) and phrase_words(plain) > rules.max_boilerplate_share * len(plain):
        return "boilerplate"
    if len(plain) >= 3 and sum(map(MENU_WORDS.__contains__, plain)) > rules.max_menu_share * len(plain):
        return "navigation"
    end = line.rstrip()
    while end.endswith(CLOSERS):
        end = end[: -len(next(c for c in CLOSERS if end.endswith(c)))]
    return "" if end.endswith(ENDS) else "punctuation"


def phrase_words(words: list[bytes]) -> int:
    """How many of a line's words stand in boilerplate phrases; a phrase's words are whole words, one after another."""
    inside: set[int] = set()
    for i, w in enumerate(words):
        for phrase in PHRASES.get(w, ()):
            if tuple(words[i : i + len(phrase)]) == phrase:
                inside.update(range(i, i + len(phrase)))
    return len(inside)


def repeat_words(words: list[bytes], k: int = 5) -> int:
    """Words in k-word windows that occur twice or more in the text, every occurrence counted."""
    n = len(words)
    if n <= k:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
    windows = np.lib.stride_tricks.sliding_window_view(ids, k)
    mixed = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (windows[:, i].astype(np.uint64) + np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - k + 1, bool)
    a, b = order[1:][same], order[:-1][same]
    equal = (windows[a] == windows[b]).all(axis=1)  # a window is compared with its neighbour of the same hash
    twice[a[equal]] = twice[b[equal]] = True
    cover = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def judge(text: bytes | None, rules: LineRules) -> tuple:
    words = words_space(text)
    n, text = len(words), text or b""
    solid = b"".join(words)
    continuation = len(solid) - len(solid.translate(None, bytes(range(0x80, 0xC0))))
    n_dup, lost, faults, kept_lines, seen = 0, 0, {}, [], set()
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in seen:
            n_dup += 1
            fault = "repeated"
        else:
            seen.add(line)
            fault = line_fault(line, own, rules)
        if fault:
            lost += len(own)
            faults[fault] = faults.get(fault, 0) + 1
        else:
            kept_lines.append(line)
    n_repeat = repeat_words(words)
    failed = n < 10 or 100 * n_repeat > 20 * n
    kept = not failed and lost <= rules.max_lost_share * n and n - lost >= min(n, rules.min_kept_words)
    cleaned = b"\n".join(kept_lines).decode()
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    return n, len(solid) - continuation, n_symbols, n_dup, n_repeat, failed, kept, lost, cleaned, sorted(faults.items())


def line_first(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), name: str = "quality", text: bool = True) -> DataFrame:
    """docs with a struct `name`: the base counts, base_failed, kept, n_lost_words, and (if text) cleaned, the text of the
    lines that passed, and faults, the number of failing lines of each rule.

    Null and empty texts have no words, so base_failed is true and cleaned is empty. A line's rules never look at other
    columns. Repeated rows are judged alike, each on its own; a very long text is held alone, whole; an empty table gives no rows.
    A column called `name` is replaced.
    """

    def make():
        def f(x):
            n, chars, symbols, dup, repeat, failed, kept, lost, cleaned, faults = judge(x, rules)
            return (n, chars, symbols, dup, repeat, failed, kept, lost) + ((cleaned, faults) if text else ())

        return f

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long"
    return per_row(docs, text_col, make, fields + (", cleaned string, faults map<string,long>" if text else ""), name, [c for c in docs.columns if c != name])


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and n_lost_words of every document; odd rows as in line_first()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_first(docs, text=False)
    return out.select("doc_id", "quality.*")
