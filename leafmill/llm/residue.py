"""Template residue, filler, error messages and script notices that stand where content should be.

One automaton holds all phrases and the openings of all placeholder notations; one pass over a text finds every hit.  A
phrase with a star goes on with a number, a code or a name, an opening with the rest of its placeholder.  Hits inside code
marks, code blocks or quotation marks are quotations and are dropped.  What is left covers letters, and coverage decides,
window by window:

* a phrase by its line, which is residue when COVERAGE of its letters are covered, or by its sentence, from SENTENCE on: a
  phrase within a sentence of other words is spoken about, not said;
* a placeholder by the stretch it stands in, with the letters, digits and signs of names and addresses that touch it, so
  that `/{id}/` inside an address is none.

The coverage of the document is the share of its letters in such windows.  It is excluded when that is above `share`,
which is 0 because TESTDATA.md counts a document whose rest is real as well; a user who wants only documents that hold
little else asks for a higher share.

Defined results: null, empty and blank texts are not excluded (they hold nothing to match); repeated rows are each
judged; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.5
SENTENCE, SENTENCE_LETTERS = 0.8, 12

# Phrases in small letters (fixed values).  A star stands for a number, a code or a name of a few characters.
ERRORS = """
404 not found | page not found | the requested document could not be located on this server | the requested url was not found
the page you were looking for doesn't exist | you may have mistyped the address | http error * | error * | error code: *
the service is unavailable | service unavailable | service temporarily unavailable | internal server error | bad gateway | gateway timeout
the viewer hit an unexpected condition | an unexpected error occurred | an unexpected error has occurred
access denied | you do not have permission to view this workbook | you do not have permission to access this | 403 forbidden
too many requests | retry after * seconds | your session has expired | sign in again to continue
oops! something went wrong while opening this file | something went wrong | please try again later
this preview cannot be displayed | traceback (most recent call last) | file "*", line * in <module> | keyerror: | valueerror: | typeerror:
nullpointerexception | this site can't be reached | the server encountered an internal error | temporarily down for maintenance
요청하신 페이지를 찾을 수 없습니다 | 오류 코드 | 페이지를 찾을 수 없습니다 | 일시적인 오류가 발생했습니다 | 잠시 후 다시 시도해 주세요
접근 권한이 없습니다 | 관리자에게 문의하세요 | 세션이 만료되었습니다 | 다시 로그인해 주세요 | 서비스를 이용할 수 없습니다 | 잘못된 접근입니다
seite nicht gefunden | fehler * | es ist ein unerwarteter fehler aufgetreten | zugriff verweigert | bitte melden sie sich erneut an
die sitzung ist abgelaufen | ihre sitzung ist abgelaufen | interner serverfehler | bitte versuchen sie es später erneut | dienst nicht verfügbar
page introuvable | erreur * | accès refusé | votre session a expiré | une erreur inattendue s'est produite | une erreur inattendue s’est produite
erreur interne du serveur | veuillez réessayer plus tard | service indisponible | veuillez vous reconnecter
página no encontrada | se ha producido un error inesperado | inténtelo más tarde | acceso denegado | su sesión ha caducado | inicie sesión de nuevo
error interno del servidor | servicio no disponible
página não encontrada | código * | acesso negado | inicie a sessão novamente | ocorreu um erro inesperado | tente novamente mais tarde
a sua sessão expirou | erro interno do servidor | serviço indisponível | erro *
ページが見つかりません | エラー * | アクセスが拒否されました | 予期しないエラーが発生しました | しばらくしてからもう一度お試しください
セッションの有効期限が切れました | もう一度ログインしてください | サーバーエラー | サービスを利用できません | 管理者に連絡してください
"""
SCRIPTS = """
please enable javascript to view this document | you need to enable javascript to run this app | this viewer requires scripts
turn on javascript and reload | javascript is disabled in your browser | some features of the editor will not work
checking your browser before opening the file | scripts and cookies must be allowed | please enable javascript | enable javascript
javascript is required | this site requires javascript | please turn on javascript | enable cookies
이 문서를 보려면 자바스크립트를 사용하도록 설정하세요 | 스크립트를 허용해야 화면이 표시됩니다 | 자바스크립트를 사용하도록 설정 | 자바스크립트를 활성화
veuillez activer javascript pour afficher ce document | veuillez activer javascript | javascript est désactivé
bitte aktivieren sie javascript, um dieses dokument anzuzeigen | bitte aktivieren sie javascript | javascript ist deaktiviert
active javascript para ver este documento | habilite javascript | javascript está desactivado
ative o javascript para ver este documento | o javascript está desativado
この文書を表示するにはjavascriptを有効にしてください | javascriptを有効にしてください | javascriptが無効
"""
FILLER = """
lorem ipsum | dolor sit amet | consectetur adipiscing elit | sed do eiusmod tempor | incididunt ut labore et | dolore magna aliqua
ut enim ad minim veniam | quis nostrud exercitation | nostrud exercitation | ullamco laboris nisi | ut aliquip ex ea commodo | consequat duis aute irure dolor
duis aute irure dolor | in reprehenderit in voluptate | velit esse cillum | dolore eu fugiat nulla pariatur | excepteur sint occaecat | cupidatat non proident
sunt in culpa qui officia | deserunt mollit anim | id est laborum
sample text | replace this text | your text here | text goes here | enter text here | insert text here | type your text here | click to add text | click to add title
todo: add text here | add text here | todo: | tbd: | add text | this is a placeholder | placeholder text | dummy text | blah blah | to be completed | content to follow | add your content here
여기에 내용을 입력하세요 | 내용을 입력하세요 | 텍스트를 입력하세요 | 여기에 텍스트를 입력 | 예시 텍스트입니다 | 제목을 입력하십시오
blindtext | beispieltext | hier steht ihr text | text hier eingeben | dies ist ein platzhalter | platzhaltertext
texte d'exemple | texte d’exemple | votre texte ici | saisissez votre texte ici | texte à remplacer | ceci est un texte
texto de ejemplo | su texto aquí | escriba aquí su texto | texto de relleno | reemplace este texto
texto de exemplo | seu texto aqui | o seu texto aqui | insira o texto aqui | substitua este texto
ここにテキストを入力してください | ここに内容を入力 | ここに文章を入力 | サンプルテキスト | ダミーテキスト
"""

# What is missing and what is said of it; each of the first with each of the second is a phrase (fixed values).
MISSING = (
    ("page | requested page | site | website | url | web address | requested resource | link",
     "not found | was not found | could not be found | cannot be found | can't be found | no longer exists | does not exist | doesn't exist | is not available | is no longer available"
     " | is currently unavailable | is temporarily unavailable | could not be loaded | failed to load | cannot be displayed | has expired"),
    ("diese seite | die seite | die angeforderte seite | diese website | die angeforderte datei | die angeforderte url",
     "existiert nicht | existiert nicht mehr | wurde nicht gefunden | konnte nicht gefunden werden | ist nicht verfügbar | ist derzeit nicht verfügbar | konnte nicht geladen werden | kann nicht angezeigt werden"),
    ("cette page | la page | la page demandée | ce site | le document demandé | l'adresse demandée",
     "n'existe pas | n'existe plus | est introuvable | n'a pas été trouvée | n'a pas été trouvé | est indisponible | n'est pas disponible | n'a pas pu être chargée | ne peut pas être affichée"),
    ("esta página | la página | la página solicitada | este sitio | el documento solicitado",
     "no existe | ya no existe | no se encuentra | no se ha encontrado | no se encontró | no está disponible | no se pudo cargar | no se puede mostrar"),
    ("esta página | a página | a página solicitada | este site | o documento solicitado",
     "não existe | já não existe | não existe mais | não foi encontrada | não foi encontrado | não está disponível | não pôde ser carregada | não pode ser exibida"),
    ("페이지를 | 요청하신 문서를 | 요청한 페이지를 | 사이트를", "찾을 수 없습니다 | 표시할 수 없습니다 | 불러올 수 없습니다 | 열 수 없습니다"),
    ("ページが | お探しのページは | このページは | ご指定のページは | サイトが", "見つかりません | 見つかりませんでした | 存在しません | 表示できません | 読み込めませんでした | 利用できません"),
)

# Notations of a placeholder (fixed values): its opening, which is in the automaton, and the whole.
_NAME = r"[A-Za-z][A-Za-z0-9_.]*"
PLACEHOLDERS = {
    "{{": r"\{\{\{?\s*[^{}\n]+?\s*\}\}\}?",
    "{%": r"\{%-?\s*\w[^%\n]*%\}",
    "<%": r"<%=?\s*[^%\n]+?%>",
    "${": r"\$\{\s*" + _NAME + r"\s*\}",
    "<<": r"<<\s*[\w ]+?\s*>>",
    "<": r"<(?i:(?:your|insert|enter|add|type)\s[\w ]+|[\w ]+\shere)>",
    "«": r"«(?:[A-Z][A-Za-z0-9_]*|[a-z][A-Za-z0-9]*_[A-Za-z0-9_]*)»",
    "@@": r"@@" + _NAME + r"@@",
    "__": r"(?<![\w])__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__(?![\w])",
    "%": r"%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%",
    "#": r"(?<![\w#])#[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*#",
    "{": r"(?<![\w$#{%])\{[A-Za-z][A-Za-z0-9_]*\}",
    "[": r"\[\s*(?:(?i:insert|enter|your|add|type|fill in|name of|tbd|tbc|to be)(?![\w])[^\[\]\n]*|(?i:name|date|title|company|amount|recipient|signature|client name)"
    r"|여기에[^\[\]\n]*|[^\[\]\n]*(?:입력|einfügen|hier eintragen|ici|aquí|aqui|を入力))\s*\](?!\()",
}
_COMPILED = {k: re.compile(v) for k, v in PLACEHOLDERS.items()}
_STAR = r"[\w.:/#()-]+"
_CROSSES = re.compile(r"^[\sxX.,]{8,}$")
_QUOTED = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|(?<!`)``?(?!`)[^`\n]+``?|\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|«\s[^»\n]+\s»|‹[^›\n]+›|「[^」\n]+」|『[^』\n]+』|‘[^’\n]+’(?!\w)",
    re.S,
)
_SENTENCE = re.compile(r"[^.!?。！？]+[.!?。！？]*")
#: What belongs to a name or an address that a placeholder is part of.
_TOUCHING = re.compile(r"[A-Za-z0-9_/.:=&?-]*")


def phrases() -> dict[str, list[str]]:
    """All phrases by kind."""
    out = {kind: [p for p in map(str.strip, re.split(r"[|\n]", part)) if p and not p.startswith("*")] for kind, part in (("error", ERRORS), ("script", SCRIPTS), ("filler", FILLER))}
    for what, said in MISSING:
        out["error"] += [f"{a.strip()} {b.strip()}" for a in what.split("|") for b in said.split("|")]
        if what[0] > "\u3000":  # scripts in which the two are often written without a space
            out["error"] += [a.strip() + b.strip() for a in what.split("|") for b in said.split("|")]
    return out


@functools.cache
def _automaton() -> tuple[ahocorasick.Automaton, dict[str, tuple[str, list[re.Pattern]]]]:
    automaton, tails = ahocorasick.Automaton(), {}
    for kind, part in phrases().items():
        for phrase in part:
            head, star, rest = phrase.partition("*")
            known = tails.setdefault(head, (kind, []))
            if star:
                known[1].append(re.compile(_STAR + ".*?".join(map(re.escape, rest.split("*"))), re.S))
            automaton.add_word(head, head)
    for opening in PLACEHOLDERS:
        automaton.add_word(opening, opening)
    automaton.make_automaton()
    return automaton, tails


def _small(text: str) -> str:
    """Small letters, character for character: a few capital letters have longer small forms."""
    small = text.lower()
    return small if len(small) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def hits(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of every phrase and placeholder outside quotations."""
    found: list[tuple[int, int, str]] = []
    small = _small(text)
    automaton, tails = _automaton()
    until: dict[str, int] = {}
    for end, head in automaton.iter(small):
        start, stop = end - len(head) + 1, end + 1
        if head in _COMPILED:
            if start >= until.get(head, 0) and (m := _COMPILED[head].match(text, start)):
                found.append((start, m.end(), "placeholder"))
                until[head] = m.end()
            continue
        kind, rest = tails[head]
        if small[start].isascii() and small[start].isalnum() and start and small[start - 1].isalnum():
            continue  # the phrase begins inside a word
        if small[end].isascii() and small[end].isalnum() and stop < len(small) and small[stop].isascii() and small[stop].isalnum() and not rest:
            continue
        for tail in rest:
            if m := tail.match(small, stop):
                stop = max(stop, m.end())
        if rest and stop == end + 1 and head.endswith(" "):
            continue  # nothing where the number or code should be
        found.append((start, stop, kind))
    if not found:
        return found
    quoted = [m.span() for m in _QUOTED.finditer(text)]
    # A placeholder may itself be written in guillemets; it is quoted only by marks outside it.
    return [h for h in found if not any(a <= h[0] and h[1] <= b and (a, b) != (h[0], h[1]) for a, b in quoted)]


def _letters(text: str) -> int:
    return sum(map(str.isalnum, text))


def _stands(text: str, start: int, stop: int) -> bool:
    """Whether a placeholder covers COVERAGE of the stretch it is part of."""
    after = _TOUCHING.match(text, stop).group()
    before = _TOUCHING.match(text[max(text.rfind("\n", 0, start), text.rfind(" ", 0, start)) + 1 : start][::-1]).group()
    return stop - start >= COVERAGE * (stop - start + _letters(before) + _letters(after))


def judge(text: str, share: float = 0.0) -> tuple[bool, str | None, float, int]:
    """(excluded, kinds joined by commas, coverage of the document, hits outside quotations) of one text."""
    free = hits(text)
    crosses = "xxxx" in text.lower()
    if not free and not crosses:
        return False, None, 0.0, 0
    covered = bytearray(len(text))
    for a, b, _ in free:
        covered[a:b] = b"\1" * (b - a)
    kinds: set[str] = set()
    total = got = at = 0
    for line in text.split("\n"):
        n = _letters(line)
        if n:
            mine = [h for h in free if at <= h[0] < at + len(line)]
            window = 0
            for a, b, kind in mine:
                if kind == "placeholder" and _stands(text, a, b):
                    kinds.add(kind)
                    window += max(_letters(text[a:b]), 1)
            said = {kind for _, _, kind in mine if kind != "placeholder"}
            if crosses and n >= 8 and _CROSSES.match(line):
                kinds.add("filler")
                window = n
            elif said and sum(1 for k, c in enumerate(line, at) if covered[k] and c.isalnum()) >= COVERAGE * n:
                kinds |= said
                window = n
            elif said:
                # The message may be one sentence of a longer line.
                for m in _SENTENCE.finditer(line):
                    piece = range(at + m.start(), at + m.end())
                    size = _letters(m.group())
                    if size >= SENTENCE_LETTERS and sum(1 for k in piece if covered[k] and text[k].isalnum()) >= SENTENCE * size:
                        kinds |= {kind for a, _, kind in mine if kind != "placeholder" and a in piece}
                        window += size
            total, got = total + n, got + min(window, n)
        at += len(line) + 1
    coverage = got / total if total else 0.0
    out = bool(kinds) and coverage > share
    return out, ",".join(sorted(kinds)) or None if out else None, coverage, len(free)


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.0) -> DataFrame:
    """(key, excluded, kinds, coverage, hits), one row for each row of `documents`."""
    source = documents.select(F.col(key), F.col(text))
    schema = f"{key} {source.dtypes[0][1]}, excluded boolean, kinds string, coverage double, hits int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, share) if t else (False, None, 0.0, 0) for t in batch.column(1).to_pylist()]
            flags, kinds, cover, hits = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(flags, pa.bool_()), pa.array(kinds, pa.string()), pa.array(cover, pa.float64()), pa.array(hits, pa.int32())],
                names=[key, "excluded", "kinds", "coverage", "hits"],
            )

    return source.mapInArrow(work, schema)


def found_residue(documents: DataFrame) -> DataFrame:
    return residue(documents).where("excluded and doc_id is not null").select("doc_id").distinct()
