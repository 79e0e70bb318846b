"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Parts of the page that say what they are by tag, class or id
(menus, headers, footers, forms, adverts, comments) are boilerplate, unless a part holds most of the page's
prose: then it is a wrapper, and what it says of itself is not believed (see ``wrappers``). The first pass
decides each block by itself. Many letters within links make a block boilerplate; a heading, or one short link
by itself, is left undecided in the article. Of the others, long ones with many function words of a language
are text, those with few are not, unless the page's language has no list here, when length decides. That
a block stands in the page's article is evidence: it decides short blocks, and long ones that their words
leave open. An article element with little text beside the page's main text is a card; its short blocks
are boilerplate. What stays undecided follows in the second pass its nearest decided neighbours if they
agree; else the article decides, on pages without one the nearer neighbour. If nothing is decided to be
text, the long undecided blocks are.

Pages are read once from front to back, in time in proportion to their length, however broken they are.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of letters in links from which a block is boilerplate.
LINKS = 0.33
#: Letters below which a block is short, and from which it is long.
SHORT, LONG = 70, 200
#: Shares of function words: below the first a long block is no text, from the second on it is.
FEW, MANY = 0.10, 0.25
#: Share of the main text's letters below which one of several articles is a card.
CARD = 0.25
#: Share of its letters below which the text outside a part counts as none.
OUTSIDE = 0.2
#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in a is that it for on was with as be by at this are or from have not but they you he she his her we which their has had were will an if would there what all been one who so when can no more",
    "de": "der die das und in zu den mit von ist auf für ein eine nicht sich des dem im es an auch als wie er sie wir ich aus bei nach war hat werden einer einen um am sind noch nur oder aber vor zur zum bis mehr durch",
    "fr": "le la les de des et en un une du que qui dans pour est sur par au pas il elle ne se ce à avec plus sont son sa ses on aux nous vous mais ou été cette leur être ont comme d l c qu n s",
    "es": "el los las la de que y en un una del se por con para su al lo como más no es a o pero sus le ha me si sin sobre este ya entre cuando muy fue son está también hasta desde nos esta",
    "it": "il lo la i gli le di a da in con su per tra e che un una è non si del della dei delle al alla nel nella sono ma anche come più o se ha questo questa l dell all d",
    "pt": "o a os as de do da dos das e que em um uma no na nos nas para com por não se mais como mas ao à é foi ser são ou seu sua pelo pela também já entre quando muito",
    "nl": "de het een en van in is op te dat die voor met zijn aan niet er ook als om door maar bij uit naar of dan nog wordt worden heeft hij ze wij ik je over deze dit kan",
    "da": "og i at det er en til af på for med den der de som ikke har et men var han sig om vi kan fra jeg så også eller efter ved over blev nu",
    "no": "og i at det er en til av på for med den som de ikke har et men var han seg om vi kan fra jeg så også eller etter ved over ble nå",
    "sv": "och i att det är en till av på för med den som de inte har ett men var han sig om vi kan från jag så också eller efter vid över blev nu",
    "fi": "ja on ei että se oli hän ovat mutta kun niin myös kuin joka mukaan sen hänen ole jo jos tai sekä vain nyt ollut mitä tämä ne he olla vielä voi sitä",
    "pl": "i w na z do że się nie to jest o jak po za od przez dla oraz ale są co tak już był była może tym ich jego jej czy a przy który która które być",
    "cs": "a v se na je že s z do o i to k ve pro za by ale jako po jsou od jeho jak které který která také byl byla už nebo při si tak ze aby",
    "hu": "a az és hogy nem is egy ez meg de van volt csak azt már ha mint még vagy el ki fel le lesz minden ezt sem után amely aki kell szerint majd",
    "ro": "și în de la a cu pe nu că un o din care este pentru mai au se să ce prin fi sau fost ale al lui dar după despre între sunt",
    "tr": "ve bir bu da de için ile çok ne gibi daha olan olarak ama var en kadar sonra her o mi ya ise değil ki diye şey veya göre",
    "el": "και το η ο να του της των με που για την τον στο στη στην τα οι τις δεν είναι από θα σε ότι ως αλλά μια ένα τους στα",
    "ru": "и в не на что с он как это по но из у за то к от же о для его все так было был бы мы вы они она а до или если уже при",
    "uk": "і в не на що з він як це по але із у за то до від ж про для його все так було був ми ви вони вона а та або якщо вже при й є",
    "ar": "في من على إلى أن عن مع هذا هذه التي الذي كان لا ما أو كما بعد قبل بين كل قد لم هو هي ذلك و",
    "id": "yang dan di ini itu dengan untuk dari dalam tidak pada adalah akan ke juga oleh karena sebagai bisa ada mereka kami saya atau telah lebih",
    "vi": "và của là có trong cho được với các không một những người này đã khi để từ đến cũng như ra về vào nhiều",
    "hi": "के का की में है और को से पर यह हैं एक ने भी कि था नहीं लिए तो इस हो कर जो थे",
}

DROPPED = "script style noscript template iframe svg math object canvas head title select option button textarea".split()
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul"
).split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
#: Blocks that are not followed as containers unless they have a name.
LEAVES = ["p", "hr", "li", "dt", "dd", "tr", "td", "th", *HEADINGS]
_ROLE = re.compile(r"(?<![\w-])role\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Tags of parts that hold no main text. Those of the second list wrap whole pages at times.
APART = "nav footer menu dialog".split()
LOOSE = "header aside form fieldset".split()
#: Words in class, id or role that name a part of the page.
NAMES = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs cookie cookies consent copyright disclaimer "
    "disqus footer header menu modal nav navbar navigation newsletter notice pagination popup promo promoted "
    "recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget".split()
)
#: Words before a name that deny it, and words that make a header one of the article.
DENIED = {"no", "with", "without", "has", "hide", "hides"}
HEADLINES = {"article", "entry", "post", "story", "content"}
#: Names of readers' comments, and the heading above them: a number and one of the words.
COMMENTS = {"comment", "comments", "commentlist", "commentform", "commentarea", "commentsection"}
_RESPONSES = re.compile(
    r"\d+\s+(?:(?:reader|user)\s+)?(?:comments?|responses?|repl(?:y|ies)|kommentare?|antworten|commentaires?"
    r"|réponses?|comentarios?|respuestas?|commenti|risposte|comentários?|reacties)\b.{0,80}\Z",
    re.I | re.S,
)

#: The attributes of a tag: quotes hold a value only after an equals sign; nothing is tried twice.
_ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
#: Where an element whose content is dropped ends, if not at its closing tag.
_ENDS = {
    "option": r"</?(?:option|optgroup|select|datalist|article|main|section|table|form|div|p|h[1-6])\b",
    "select": r"</select\s*>|<(?:select|input|textarea|article|main|section|p|h[1-6])\b",
    "button": r"</button\s*>|<(?:button|article|main)\b",
    "head": r"</head\s*>|<body\b",
}
_ENDS = {tag: re.compile(_ENDS.get(tag, rf"</{tag}\s*>"), re.I) for tag in DROPPED}
#: Words of letters and the marks that some scripts write vowels with.
_WORDS = re.compile(r"(?:[^\W\d_]|[\u0900-\u0963])+")
#: Characters of scripts without spaces, which say as much as some letters.
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _lang, _listed in FUNCTION_WORDS.items():
    for _word in set(_listed.split()):
        _LANGUAGES[_word] = (*_LANGUAGES.get(_word, ()), _lang)


class Block(NamedTuple):
    """Text, letters in links, number of links, tag if it is a heading, numbers of the innermost part that
    names itself and of the innermost article around it (-1: none)."""

    text: str
    linked: int
    links: int
    heading: str
    part: int
    article: int


class Scope(NamedTuple):
    """An article or a part that names itself: its tag, or "firm" or "loose"; the next one around it."""

    kind: str
    outer: int


class Page:
    """Blocks of a page, its article and main elements, and the parts that name themselves."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.articles: list[Scope] = []
        self.parts: list[Scope] = []
        self.main: set[int] = set()  # parts that hold an article, a main element or a main heading
        self.open: list[tuple[str, int, int]] = []  # tag, innermost part, innermost article
        self.depth: Counter = Counter()  # open elements by tag
        self.pieces: list[str] = []
        self.heading = ""
        self.linked = self.links = self.in_link = 0
        self._read(html)
        self._end_block()

    def _text(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw)
            self.pieces.append(text)
            if self.in_link:
                self.linked += len(text.strip())

    def _around(self) -> tuple[int, int]:
        return self.open[-1][1:] if self.open else (-1, -1)

    def _holds_main(self, part: int) -> None:
        while part >= 0 and part not in self.main:
            self.main.add(part)
            part = self.parts[part].outer

    def _part(self, kind: str, outer: int) -> int:
        self.parts.append(Scope(kind, outer))
        return len(self.parts) - 1

    def _end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.pieces)).strip()
        if text:
            part, article = self._around()
            if self.heading == "h1":
                self._holds_main(part)
            if self.heading and self.open and _RESPONSES.match(text):  # what follows here are comments
                part = self._part("firm", part)
                self.open[-1] = (self.open[-1][0], part, article)
            self.blocks.append(Block(text, self.linked, self.links, self.heading, part, article))
        self.pieces, self.linked, self.links = [], 0, 0

    def _read(self, html: str) -> None:
        at, n, last = 0, len(html), html.rfind(">")
        quotes = True  # whether a closing angle may stand in quotes
        endless: set[str] = set()
        while True:
            start = html.find("<", at)
            if start < 0 or start > last:
                comment = html.find("<!--", at) if start >= 0 else -1
                self._text(html[at : comment if comment >= 0 else n])
                return
            if html.startswith("<!--", start):
                self._text(html[at:start])
                end = html.find("-->", start + 4)
                if end < 0:
                    return
                at = end + 3
                continue
            if html[start + 1] in "!?":
                self._text(html[at:start])
                at = html.find(">", start) + 1
                continue
            found = _TAG.match(html, start + 1)
            if not found:
                self._text(html[at : start + 1])
                at = start + 1
                continue
            self._text(html[at:start])
            end = _ATTRIBUTES.match(html, found.end()).end() if quotes else n
            if end == n:  # no angle outside of quotes follows, here or behind
                quotes, end = False, html.find(">", found.end())
            attributes, at = html[found.end() : end], end + 1
            closing, tag = bool(found[1]), found[2].lower()
            if tag in _ENDS:
                if not closing and not attributes.rstrip().endswith("/") and tag not in endless:
                    over = _ENDS[tag].search(html, at)
                    if over:
                        at = over.end() if over[0].startswith("</" + tag) and over[0].endswith(">") else over.start()
                    elif tag in ("script", "style"):
                        return
                    else:
                        endless.add(tag)
            elif tag == "br":
                self.pieces.append(" ")
            elif tag == "a":
                self.in_link = 0 if closing else 1
                self.links += self.in_link
            elif tag in BLOCKS:
                self._end_block()
                self.in_link = 0
                self.heading = tag if tag in HEADINGS and not closing else ""
                self._nest(tag, closing, attributes)

    def _nest(self, tag: str, closing: bool, attributes: str) -> None:
        if closing:
            while self.depth[tag]:
                gone = self.open.pop()[0]
                self.depth[gone] -= 1
                if gone == tag:
                    break
            return
        named = _NAMED.search(attributes)
        if tag in LEAVES and not named:
            return
        part, article = self._around()
        kind = kind_of(tag, attributes if named else "", article >= 0)
        if kind:
            part = self._part(kind, part)
        if tag in ("article", "main") or named and "main" in (x.strip("\"' ").lower() for x in _ROLE.findall(attributes)):
            self._holds_main(part)
            self.articles.append(Scope(tag, article))
            article = len(self.articles) - 1
        self.open.append((tag, part, article))
        self.depth[tag] += 1


def kind_of(tag: str, attributes: str, inside: bool) -> str:
    """"firm" for a part that surely holds no text by its tag, or as one of its names says nothing else;
    "loose" if a name is one word of several, or the tag often wraps pages; else empty. ``inside``: within an
    article, where a header holds the headline."""
    if tag in ("html", "body", "article", "main"):
        return ""
    kind = "firm" if tag in APART else "loose" if tag in LOOSE and not (tag == "header" and inside) else ""
    for found in _NAMED.finditer(attributes):
        for name in "".join(filter(None, found.groups())).lower().split():
            words = _TOKEN.findall(name)
            if COMMENTS.intersection(words):
                return "firm"
            hits = [k for k, w in enumerate(words) if w in NAMES and not (k and words[k - 1] in DENIED)]
            if all(words[k] == "header" for k in hits) and (inside or HEADLINES.intersection(words)):
                hits = []
            if hits:
                kind = "firm" if len(words) == 1 else kind or "loose"
    return kind


def function_share(text: str) -> float:
    """Share of function words, in the language of which there are most."""
    words = _WORDS.findall(text.lower())
    hits = Counter(lang for w in words for lang in _LANGUAGES.get(w, ()))
    return max(hits.values(), default=0) / len(words) if words else 0.0


def size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def plain(block: Block) -> bool:
    """Whether few of a block's letters stand in links."""
    return block.linked <= LINKS * len(block.text)


def wrappers(page: Page) -> set[int]:
    """The parts that are no boilerplate though they name themselves so, as they wrap the page's main text.

    A part wraps if it holds more than half of the letters outside links and either an article, a main element
    or a main heading, or, with at least one long block, all but a small share of what would stay without
    it. Firm parts are asked only where nothing would stay otherwise, and need an article, a main element or a
    main heading. Parts within a part that does not wrap are boilerplate with it.
    """
    if not page.parts:
        return set()
    own, inside, free = [0] * len(page.parts), [0] * len(page.parts), 0
    long = [False] * len(page.parts)
    for block in page.blocks:
        n = size(block.text) - block.linked if plain(block) else 0
        if block.part < 0:
            free += n
        else:
            own[block.part] += n
            long[block.part] |= n >= LONG
    for k in range(len(page.parts) - 1, -1, -1):  # outer parts have smaller numbers
        inside[k] += own[k]
        outer = page.parts[k].outer
        if outer >= 0:
            inside[outer] += inside[k]
            long[outer] |= long[k]
    total = free + sum(n for n, p in zip(inside, page.parts, strict=True) if p.outer < 0)
    found: set[int] = set()
    for firm in (False, True):
        if firm and free:
            break
        for k, (kind, outer) in enumerate(page.parts):
            if k in found or outer >= 0 and outer not in found or 2 * inside[k] <= total or kind == "firm" and not firm:
                continue
            if k in page.main or kind == "loose" and long[k] and free < OUTSIDE * inside[k]:
                found.add(k)
                free += own[k]
    return found


def evidence(page: Page, prose: list[bool], shares: list[float], known: bool) -> list[bool | None]:
    """For each block whether it stands in the page's article (True), in a card (False) or in neither."""
    own: Counter = Counter()
    for block, counts, share in zip(page.blocks, prose, shares, strict=True):
        if counts:
            n = size(block.text)
            if block.article >= 0:
                own[block.article] += n - block.linked
            elif n >= LONG and (share >= MANY or share < FEW and not known):
                own[-1] += n
    best = max(own.values(), default=0)
    several = sum(page.articles[k].kind == "article" for k in own if k >= 0) > 1
    held = set()
    for k, n in own.items():
        if k >= 0 and (n >= CARD * best or page.articles[k].kind == "article" and not several):
            while k >= 0 and k not in held:  # and those around it
                held.add(k)
                k = page.articles[k].outer
    return [
        None if b.article < 0 else True if b.article in held else False if page.articles[b.article].kind == "article" else None
        for b in page.blocks
    ]


def decide(block: Block, apart: bool, share: float, article: bool | None, known: bool, alone: bool) -> bool | None:
    """First pass: whether a block is text; None if it does not say. ``share`` is that of function words,
    ``known`` whether the page's language has a list of them, ``alone`` whether no neighbour is mostly links."""
    if apart:
        return False
    n = size(block.text)
    if not plain(block):
        if article and n < SHORT:
            return None if block.links == 1 and (alone or block.heading == "h1") else False
        return None if article else False
    if n < SHORT:
        return article
    few = share < FEW
    if n < LONG:
        return None if few and known else article
    if share >= MANY or few and not known:
        return True
    if few:
        return None if article else False
    return article or None


def main_text(html: str) -> str:
    """The text blocks of a page, one per line."""
    page = Page(html)
    blocks = page.blocks
    wraps = wrappers(page)
    away: list[bool] = []  # of each part, whether it or one around it is boilerplate
    for k, (_, outer) in enumerate(page.parts):
        away.append(k not in wraps or outer >= 0 and away[outer])
    apart = [b.part >= 0 and away[b.part] for b in blocks]
    few_links = [plain(b) for b in blocks]
    prose = [x and not y for x, y in zip(few_links, apart, strict=True)]
    shares = [function_share(b.text) if x and size(b.text) >= SHORT else 0.0 for b, x in zip(blocks, prose, strict=True)]
    weights = [size(b.text) if x and size(b.text) >= SHORT else 0 for b, x in zip(blocks, prose, strict=True)]
    known = sum(x * n for x, n in zip(shares, weights, strict=True)) >= FEW * sum(weights)
    articles = evidence(page, prose, shares, known)
    has_article = True in articles
    alone = [all(few_links[max(k - 1, 0) : k]) and all(few_links[k + 1 : k + 2]) for k in range(len(blocks))]
    first = [decide(b, apart[k], shares[k], articles[k], known, alone[k]) for k, b in enumerate(blocks)]
    if True not in first:
        first = [True if x is None and size(b.text) >= LONG else x for x, b in zip(first, blocks, strict=True)]
    before, after, last = [], [], None
    for k, x in enumerate(first):
        last = (k, x) if x is not None else last
        before.append(last)
    last = None
    for k in range(len(first) - 1, -1, -1):
        last = (k, first[k]) if first[k] is not None else last
        after.append(last)
    after.reverse()
    kept = []
    for k, block in enumerate(blocks):
        x = first[k]
        if x is None:
            a, b = before[k], after[k]
            if has_article and not (a and b and a[1] == b[1]):
                x = articles[k] is True
            elif a and b and a[1] != b[1]:
                near, far = k - a[0], b[0] - k
                x = near < far if a[1] else far < near
            else:
                x = a[1] if a else b[1] if b else True
        if x:
            kept.append(block.text)
    return "\n".join(kept)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch["html"]]
        yield batch.drop_columns(["html"]).append_column("text", pa.array(texts, pa.string())).append_column(
            "n_chars", pa.array([len(t) for t in texts], pa.int64())
        )


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text (blocks joined by line
    feeds, empty if there are none) and n_chars (its code points).

    A null html is an empty one. Character references are decoded, white space within a block becomes
    one space. Repeated pages give repeated rows, other columns are ignored, an empty table gives no
    rows; unclosed or misplaced tags and comments never fail. A
    part that says it is a menu, a header, comments or the like is left out unless it wraps the main text.
    """
    rows = pages.select("page_id", "url", pages[html].alias("html"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(
        _extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long"
    )
