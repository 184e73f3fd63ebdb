"""Line-first cleaning: rules per line, removal of failing lines, then rejection of documents that lose too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Share of a document's word characters that removal may take before the document is rejected.
MOST_LOST = 0.5
#: Lines with fewer words than this need no closing punctuation (headings, list items).
SHORT_LINE = 8
#: A line may end with these, with closing quotes or brackets after them.
CLOSING = ".!?:;…。！？।"
AFTER_CLOSING = "\"'»”’)] \t\r"
#: Separators of navigation bars.
SEPARATORS = "|»›•·"
# Whole lines that are navigation, in four languages.
NAVIGATION = frozenset(
    "home menu next previous share tweet print login log-in sign-up subscribe startseite menü weiter zurück teilen drucken anmelden abmelden inicio menú siguiente anterior compartir imprimir accueil suivant précédent partager imprimer connexion".split()
) | {
    "back to top", "skip to content", "log in", "sign up", "read more", "click here", "nach oben", "zum inhalt", "mehr lesen", "hier klicken", "volver arriba", "leer más", "iniciar sesión", "haut de page", "lire la suite", "se connecter",
}
#: Phrases of boilerplate in four languages; they condemn lines of at most BOILERPLATE_WORDS words.
BOILERPLATE_WORDS = 16
BOILERPLATE = (
    "lorem ipsum", "enable javascript", "javascript is disabled", "javascript is required", "we use cookies", "site uses cookies", "cookie policy",
    "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here to", "subscribe to our newsletter", "powered by", "page not found", "access denied",
    "javascript aktivieren", "wir verwenden cookies", "diese website verwendet cookies", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "klicken sie hier", "newsletter abonnieren", "seite nicht gefunden", "zugriff verweigert",
    "habilitar javascript", "utilizamos cookies", "este sitio usa cookies", "política de privacidad", "términos de uso", "todos los derechos reservados", "haga clic aquí", "suscríbase a nuestro boletín", "página no encontrada", "acceso denegado",
    "activer javascript", "nous utilisons des cookies", "ce site utilise des cookies", "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "cliquez ici", "abonnez-vous à notre", "page non trouvée", "accès refusé",
)
#: A line is a list of links if these make up half of its characters.
LINK = re.compile(r"(?:https?://|www\.)\S+")
#: So many neighbouring lines of at most MENU_WORDS words without a sentence's end are a menu, whatever the language.
MENU_LINES, MENU_WORDS = 6, 3
#: A word with a tail of symbols.
_SYMBOL_WORD = re.compile(r"[#*$%&|<>!]{2,}(?:\s|$)")


def line_fault(line: str) -> str | None:
    """The first rule that the line breaks, or None. Blank lines break none."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if "://" in line or "www." in line:
        if 2 * sum(len(x) for x in LINK.findall(line)) >= len(line.strip()):
            return "links"
    bars = sum(map(line.count, SEPARATORS))
    if bars >= 3 and 4 * bars >= n:
        return "navigation"
    if n <= BOILERPLATE_WORDS:
        low = line.lower()
        if n <= 3 and low.strip(" .!>»") in NAVIGATION:
            return "navigation"
        if any(phrase in low for phrase in BOILERPLATE):
            return "boilerplate"
    if n >= 5 and sum(map(line.count, "#*$%&|<>!")) > n and 2 * len(_SYMBOL_WORD.findall(line)) > n:
        return "symbols"
    if n >= 10 and 4 * len(set(words)) < n:
        return "repetition"
    if n >= SHORT_LINE and line.rstrip(AFTER_CLOSING)[-1:] not in CLOSING:
        return "punctuation"
    return None


def menus(lines: list[str]) -> set[int]:
    """Places of lines that stand in a run of MENU_LINES or more short ones without a sentence's end; blank lines do not end a run."""
    out: set[int] = set()
    run: list[int] = []
    for i, line in enumerate([*lines, "end " * (MENU_WORDS + 1)]):
        bare = line.strip(WHITE)
        if not bare:
            continue
        if len(bare.split(None, MENU_WORDS)) <= MENU_WORDS and bare.rstrip(AFTER_CLOSING)[-1:] not in CLOSING:
            run.append(i)
            continue
        if len(run) >= MENU_LINES:
            out |= set(run)
        run = []
    return out


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of `width` words that occur more than once in the text, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = hashes[:n].copy()
    for i in range(1, width):
        rolled *= _ODD
        rolled += hashes[i : n + i]
    if len(np.unique(rolled)) == n:  # equal windows have equal hashes, so there are none
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    seen: set = set(windows)
    if len(seen) == len(windows):
        return 0
    once: set = set()
    twice = {w for w in windows if w in once or once.add(w)}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + width - max(i, end)
            end = i + width
    return covered


_ODD = np.uint64(0x9E3779B97F4A7C15)
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def measure(text: str | None) -> dict:
    """All figures of one text and its cleaned form.

    Null is like an empty text: no words, so base_failed. Words end at ASCII white space only.
    A line counts as a repeat if it has a word and equals an earlier line of the text.
    """
    text = text or ""
    words = text.encode().split()
    lines = text.split("\n")
    seen: set[str] = set()
    repeats, kept, faults, lost = 0, [], [], 0
    menu = menus(lines) if len(lines) >= MENU_LINES else set()
    for i, line in enumerate(lines):
        size = len(line)
        if not line.strip(WHITE):
            kept.append(line)
            continue
        if line in seen:
            repeats += 1
        seen.add(line)
        fault = "menu" if i in menu else line_fault(line)
        if fault:
            faults.append(fault)
            lost += size
        else:
            kept.append(line)
    n = len(words)
    again = repeated_words(words)
    total = sum(len(x) for x in lines)
    failed = n < 10 or 100 * again > 20 * n
    share = lost / total if total else 0.0
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, WHITE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": repeats,
        "n_repeat_words": again,
        "base_failed": failed,
        "kept": not failed and share <= MOST_LOST,
        "lost_share": share,
        "n_lines_removed": len(faults),
        "cleaned_text": "\n".join(kept),
    }


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_share double, n_lines_removed long"


def line_rules(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, the figures and verdict of measure() and, with_text, cleaned_text, for every row of docs.

    A document is kept if the base rules pass (ten words or more, at most a fifth of them in repeated
    windows) and removal of failing lines costs at most MOST_LOST of its characters. Repeated rows and
    rows without doc_id come back as they are; other columns are ignored; no rows give no rows.
    """
    fields = _FIELDS + ", cleaned_text string" * with_text
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[name] for r in rows], kind) for name, kind in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {fields}")


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_rules over documents, without the texts."""
    return line_rules(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op8_line_rules": op8_line_rules}
SQL: dict[str, str] = {}
