"""Main text of web pages: flat text blocks, classified by a decision tree over themselves and their neighbours.

A page is cut into flat blocks at every block-level tag. A block's features are its number of words and its link density
(share of words inside links), the same of the blocks before and after it, whether it is a heading, ends a sentence or
opens with a copyright sign, and where it stands: ``barred`` in a menu, footer, sidebar, form, hidden element or a container
named as an advert or comments; ``named`` in a container whose name or kind only suggests other matter (a notice, social,
the header of an article; any telling name of a paragraph itself); ``inside`` an article, or ``beside`` one that holds
half of the page's words; ``inside_after``, the next block is inside. A decision tree (CART, Gini), trained on the small
labelled table below and on what a rule adds to it (``clear_cases``), keeps or drops each block. Barred blocks are what the contract leaves out; a name that only
suggests carries both labels in the table, and words, links, sentence ends and neighbours decide.

Defined results: a null or empty page, or one without main text, gives the empty text; unclosed tags, comments
and scripts reach to the end of the page; character references are decoded, an unfinished one stays as it is;
repeated rows are extracted alike; an empty table gives an empty result; nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("barred", "named", "inside", "beside", "heading", "ends", "rights", "inside_after", "words", "links", "words_before", "links_before", "words_after", "links_after")

#: The labelled table: features as in FEATURES (link densities in percent), then 1 for main text.
LABELLED = """
1 0 0 0 0 0 0 0   1 100   0   0   1 100  0
1 0 0 0 0 0 0 0   3 100   1 100   2 100  0
1 0 0 0 0 0 0 0  12   0   1 100   8   0  0
1 0 0 0 0 1 0 0  45   0  80   0  60   0  0
1 0 0 0 0 0 0 0   8   0  70   0   0   0  0
1 0 0 0 0 1 0 0  25  10   5   0   5   0  0
1 0 0 0 0 1 0 0 120   0  10   0  90   0  0
1 0 0 0 0 0 0 0   4  50  90   0   4  50  0
1 0 0 0 1 0 0 0   3   0   0   0  40   0  0
1 0 0 0 1 0 0 0   6   0  60   0   2 100  0
1 0 0 0 0 1 0 0  60   0   0   0   0   0  0
1 0 0 0 0 0 0 0   2   0   2   0   2   0  0
1 0 0 0 0 1 0 0  30   0  50   0  50   0  0
1 0 0 0 0 0 0 0   5 100  80   0  80   0  0
1 0 0 0 1 0 0 0   4   0  80   0  20   0  0
1 0 0 0 0 1 0 0  90   0  40   0  40   0  0
1 0 0 0 0 1 0 0 200   0  90   0  40   0  0
1 0 0 0 0 1 0 0  80   0   0   0 150   0  0
1 0 0 0 0 1 0 0 150   5  60   0  70   0  0
1 0 0 0 0 0 0 0  10   0  90   0  60   0  0
1 0 0 0 0 0 0 0   6 100   0   0  80   0  0
1 0 0 0 0 0 0 0   1 100   1 100  90   0  0
1 0 0 0 0 1 0 0  40   0  40   0  40   0  0
1 0 0 0 0 1 0 0  95   0 100   0   0   0  0
1 0 0 0 0 0 0 0  18  20  50   0  45   0  0
1 0 0 0 1 0 0 0   5   0  90   0  70   0  0
1 0 0 0 1 0 0 0   8   0   0   0  90   0  0
1 0 0 0 0 1 0 0  70  10 120   0   3   0  0
1 0 0 0 0 1 0 0 110   0  20   0  30   0  0
1 0 0 0 0 1 0 0 160   0  70   0  90   0  0
1 0 0 0 0 0 0 0  20   0  90   0   0   0  0
1 0 0 0 0 0 0 0  10  40  60   0  75   0  0
0 0 1 0 1 0 0 1   7   0  10   0  60   0  1
0 0 1 0 1 0 0 1   1   0   0   0   1   0  1
0 0 1 0 1 0 0 1   9   0  70   0  50   0  1
0 0 1 0 1 0 0 1   5 100   0   0  80   0  1
0 0 1 0 0 1 0 1   1   0  60   0  60   0  1
0 0 1 0 0 0 0 1   2   0   0   0   0   0  1
0 0 1 0 0 1 0 1   1   0   3   0   2   0  1
0 0 1 0 0 1 0 1   9   0   7   0  12   0  1
0 0 1 0 0 1 0 1  60   0   7   0  80   0  1
0 0 1 0 0 1 0 1 150   5  90   0   4  50  1
0 0 1 0 0 1 0 1  80  10  80   0  80   0  1
0 0 1 0 0 1 0 1  25  30  60   0  60   0  1
0 0 1 0 0 0 0 1   4  50  40   0  60   0  1
0 0 1 0 0 0 0 1  12  60  40   0  60   0  1
0 0 1 0 0 0 0 1   6 100  50   0  70   0  1
0 0 1 0 0 1 0 1   1 100  30   0  30   0  1
0 0 1 0 1 0 0 1   6   0   1 100  60   0  1
0 0 1 0 1 0 0 1   2   0   3 100   5   0  1
0 0 1 0 1 0 0 1   9   0   2 100  30   0  1
0 0 1 0 0 1 0 1   3   0   6 100   4   0  1
0 0 1 0 0 1 0 1   7   0   1 100  60   0  1
0 0 1 0 0 0 0 1   2   0   2 100   1 100  1
0 0 1 0 0 1 0 1  20   0   5 100  40   0  1
0 0 1 0 0 1 0 1  30  10   3 100   8   0  1
0 0 1 0 0 1 0 1   1   0   2 100   3   0  1
0 0 1 0 0 1 0 1  25   0   1 100   0   0  1
0 0 1 0 0 1 0 1   5 100   3 100  40   0  1
0 0 1 0 0 0 0 1   4 100   4 100   4 100  0
0 0 1 0 0 0 0 1   2 100   2 100   2 100  0
0 0 1 0 0 0 0 1   6 100   5 100   6 100  0
0 0 1 0 0 0 0 1   1 100   1 100   3 100  0
0 0 0 0 1 0 0 0   8   0   3   0  70   0  1
0 0 0 0 1 0 0 0   6   0  60   0  45   0  1
0 0 0 0 1 0 0 0   5   0  30   0  30   0  1
0 0 0 0 1 0 0 0   7   0   2 100  60   0  1
0 0 0 0 1 0 0 0   9   0   1 100  80   0  1
0 0 0 0 1 0 0 0   4   0   3 100  30   0  1
0 0 0 0 1 0 0 0   6   0   1 100   3   0  0
0 0 0 0 1 0 0 0   4   0   3 100   3 100  0
0 0 0 0 1 0 0 0   3   0   2   0   4   0  0
0 0 0 0 1 0 0 0   4   0   5 100   5   0  0
0 0 0 0 0 1 0 0  60   0  70   0  55   0  1
0 0 0 0 0 1 0 0  40   0   8   0  90   0  1
0 0 0 0 0 1 0 0  90   5  40   0   3   0  1
0 0 0 0 0 1 0 0  30  10  80   0  60   0  1
0 0 0 0 0 1 0 0 200   0   0   0   0   0  1
0 0 0 0 0 1 0 0  22   0   6   0  30   0  1
0 0 0 0 0 1 0 0  18   0  60   0  50   0  1
0 0 0 0 0 1 0 0   9   0  60   0  70   0  1
0 0 0 0 0 0 0 0   4   0  80   0  90   0  1
0 0 0 0 0 1 0 0  16   0  40   0   4   0  1
0 0 0 0 0 1 0 0  35   0   2 100   2 100  1
0 0 0 0 0 0 0 0   1 100   1 100   1 100  0
0 0 0 0 0 0 0 0   2 100   0   0   2 100  0
0 0 0 0 0 0 0 0   3  60   4 100   4 100  0
0 0 0 0 0 0 0 0  10  80   5 100  10  80  0
0 0 0 0 0 0 0 0  30  90  20  80  20  90  0
0 0 0 0 0 0 0 0   4   0   3   0   3   0  0
0 0 0 0 0 0 0 0   6   0   4 100   5   0  0
0 0 0 0 0 0 0 0   3   0   0   0   3 100  0
0 0 0 0 0 1 0 0   8   0   5   0   0   0  0
0 0 0 0 0 0 0 0   5   0  10  80   8   0  0
0 0 0 0 0 0 0 0   2   0   1   0   1   0  0
0 0 0 0 0 0 0 0  12  50   6   0   6  50  0
0 0 0 0 0 0 0 0   1 100   1 100  60   0  0
0 0 0 0 0 0 0 0   3  70   0   0  80   0  0
0 0 0 0 0 0 0 0   5 100   4 100  90   0  0
0 0 0 0 0 0 0 0   8  90  60   0   0   0  0
0 0 0 0 0 0 0 0  40  95   0   0  80   0  0
0 0 0 0 0 0 0 0  25  90  70   0  70   0  0
0 0 0 0 0 0 0 0   5   0  70   0   1 100  0
0 0 0 0 0 0 0 0   6   0  80   0   0   0  0
0 0 0 0 0 0 0 0   3  30  40   0   2   0  0
0 0 0 0 0 1 0 0  55   0   0   0   3 100  1
0 0 0 0 0 1 0 0  14   0  60   0  14   0  1
0 0 0 0 0 1 0 0  13   0  14   0  50   0  1
0 0 0 0 0 1 0 0  70   0  70   0   2   0  1
0 0 0 0 0 1 0 0  28   0   0   0   0   0  1
0 0 0 0 1 0 0 0  10   0   0   0   0   0  0
0 0 0 0 1 0 0 0   2   0  70   0   4 100  0
0 0 0 0 1 0 0 0   7   0  50   0  20   0  1
0 1 1 0 0 1 0 1  12   0  14   0  30   0  1
0 1 1 0 0 1 0 1  40   0  40   0  40   0  1
0 1 1 0 0 1 0 0  40   0  40   0   0   0  1
0 1 1 0 0 1 0 1  25   5   9   0  60   0  1
0 1 1 0 0 1 0 0  10   0  12   0   0   0  1
0 1 1 0 1 0 0 1   2   0   0   0  13   0  1
0 1 1 0 1 0 0 1   7   0   1 100  60   0  1
0 1 1 0 0 0 0 1   4   0   7   0  60   0  0
0 1 1 0 0 0 0 1   2 100   3 100  20   0  0
0 1 1 0 0 0 0 0   3  70  50   0   0   0  0
0 1 1 0 0 0 0 1   6  40  30   0   4 100  0
0 1 1 0 0 0 0 1   1 100   1 100   1 100  0
0 1 1 0 0 0 0 1   5   0   0   0  10   0  0
0 1 1 0 0 1 0 1   9  60  40   0  30   0  0
0 1 0 0 0 1 0 0  30   0  60   0  40   0  1
0 1 0 0 0 1 0 0  16   0  45   0  70   0  1
0 1 0 0 0 1 0 0  45   0   5   0  45   0  1
0 1 0 0 0 1 0 0  20   0   0   0   0   0  0
0 1 0 0 0 0 0 0   6   0   0   0   3 100  0
0 1 0 0 0 1 0 0  14  30   0   0   4 100  0
0 1 0 0 0 0 0 0   3 100  20   0   3 100  0
0 1 0 0 0 1 0 0  12  20  70   0   0   0  0
0 1 0 1 0 1 0 0  30   0  60   0   0   0  0
0 1 0 1 0 1 0 0  12   0   0   0   9   0  0
0 1 0 1 0 0 0 1   5   0   0   0   9   0  0
0 0 0 1 0 1 0 0  12   0   1 100   8   0  0
0 0 0 1 0 1 0 1   9   0   1 100   8   0  0
0 0 0 1 0 1 0 1  25   0   2 100  12   0  0
0 0 0 1 0 1 0 0  40   0  60   0  30   0  0
0 0 0 1 0 1 0 0  70   0  35   0  20   0  0
0 0 0 1 0 1 0 0  18   0  40   0   0   0  0
0 0 0 1 0 1 0 0   8   0  30   0  15   0  0
0 0 0 1 0 0 0 0   3   0  40   0  25   0  0
0 0 0 1 0 0 0 1   4  50   1 100   7   0  0
0 0 0 1 0 0 0 0   1 100   1 100   1 100  0
0 0 0 1 0 0 0 1   1 100   1 100   6   0  0
0 0 0 1 0 0 0 0  30  90  20  80  20  90  0
0 0 0 1 1 0 0 0   2   0  40   0  30   0  0
0 0 0 1 1 0 0 0   3   0  70   0   3 100  0
0 0 0 1 1 0 0 0   4   0   0   0  15   0  0
0 0 0 1 1 0 0 1   6   0   1 100  40   0  1
0 0 0 1 1 0 0 1   9   0   0   0  60   0  1
0 0 0 1 1 0 0 1   1   0   4 100   5   0  1
0 0 0 0 0 0 1 0   6   0  30   0   0   0  0
0 0 0 0 0 1 1 0   8   0  60   0   0   0  0
0 0 0 0 0 1 1 0  14  10  60   0   0   0  0
0 0 0 0 0 1 1 0  30   0   4 100   0   0  0
0 0 1 0 0 1 1 0   8   0  30   0   0   0  0
0 0 1 0 0 0 1 0   5   0  60   0   0   0  0
0 0 1 0 0 1 1 0  16   0  45   0   2 100  0
0 0 0 1 0 1 1 0   8   0  30   0   0   0  0
1 0 0 0 0 1 1 0  20  20  30   0   0   0  0
0 0 0 0 1 0 0 0   1   0   0   0   3   0  1
0 0 0 0 0 1 0 0   3   0   1   0   0   0  1
0 0 0 0 1 0 0 0   2   0   0   0   5   0  1
0 0 0 0 0 1 0 0   5   0   2   0   0   0  1
0 0 0 0 0 1 0 0   4   0   5   0   6   0  1
0 0 0 0 0 1 0 0   6   0   4   0   0   0  1
0 0 0 0 0 1 0 0   7   0   1   0   8   0  1
0 0 0 0 0 1 0 0   3   0  60   0  60   0  1
0 0 0 0 0 1 0 0   2   0  30   0  30   0  1
0 0 0 0 0 1 0 0  30   0   1 100  30   0  1
0 0 0 0 0 1 0 0  30   0   0   0   0   0  1
0 0 0 0 0 1 0 0  12   0   0   0  13   0  1
0 0 0 0 0 1 0 0   4   0   3 100   3 100  0
0 0 0 0 0 1 0 0   3  30   2 100   2 100  0
0 0 0 0 0 1 0 0  10  70  30   0   0   0  0
0 0 1 0 0 0 0 1   3   0  40   0  40   0  1
0 0 1 0 0 0 0 1  14   0  40   0  40   0  1
0 0 1 0 0 0 0 0  14   0  40   0   0   0  1
0 0 1 0 0 1 0 1   3   0   1   0   0   0  1
0 0 1 0 0 1 0 0   3   0   1   0   2 100  1
0 0 1 0 0 1 0 0  60   0  50   0  12   0  1
0 0 1 0 0 1 0 0   1   0  50   0   8   0  1
0 0 1 0 0 0 0 0   1   0  50   0   8   0  1
0 0 1 0 1 0 0 1   1   0   1 100   1   0  1
0 0 1 0 1 0 0 1   8   0   8   0   1   0  1
0 0 1 0 0 0 0 1   1 100   1   0   1 100  1
0 0 0 1 1 0 0 0   1   0  60   0   1   0  0
0 0 0 1 1 0 0 0   1   0  20   0  40   0  0
0 0 0 1 1 0 0 0   7   0  90   0  10   0  0
0 0 0 1 1 0 0 0   5   0   8   0  60   0  0
0 0 0 1 0 0 0 0   1   0   1   0  20   0  0
0 0 0 1 0 0 0 0   2   0  25   0  40   0  0
0 0 0 1 0 0 0 0   6   0  60   0  80   0  0
0 0 0 1 0 0 0 0  14   0  20   0   9   0  0
0 0 0 1 0 0 0 1  12   0   3 100  70   0  0
0 0 0 1 0 1 0 0 150   0  60   0   5   0  0
0 0 0 1 0 1 0 0  33   5   1   0   1   0  0
0 0 0 0 0 0 0 0  40   0  40   0   0   0  1
0 0 0 0 0 0 0 0  40   0   2   0  40   0  1
0 0 0 0 0 0 0 0  25   0  30   0   1   0  1
0 0 0 0 0 0 0 0  90   0  60   0  80   0  1
0 0 0 0 0 0 0 0  40   0  40   0   3   0  1
0 0 1 0 0 0 0 0  40   0  40   0   0   0  1
0 0 1 0 0 0 0 1  40   0   2   0  40   0  1
0 1 1 0 0 0 0 0  50   0  40   0  30   0  1
0 1 1 0 0 0 0 1  35   0   2   0  30   0  1
0 1 1 0 0 1 0 0   8   0   9   0   0   0  1
0 1 1 0 0 1 0 0   9   0  12   0   0   0  1
0 1 1 0 0 1 0 1   8   0  60   0  60   0  1
0 1 1 0 0 1 0 0   5   0  30   0   0   0  1
0 1 1 0 0 1 0 1   6   0   5   0  30   0  1
0 1 1 0 0 1 0 0   7  80  30   0   0   0  0
"""

DEPTH, LEAST_ROWS = 10, 1
REGION = 50  # percent of a page's unbarred words that an article must hold to be one

_DROP_TAGS = frozenset("nav footer aside form menu dialog button select".split())
_KEEP_TAGS = frozenset("article main".split())
_SKIP_TAGS = frozenset("script style noscript template iframe svg title textarea object canvas annotation annotation-xml audio video xmp noembed noframes".split())
_RAW_TAGS = frozenset("script style title textarea iframe noscript xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input link meta math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle mpadded mphantom semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAR_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|promo|promos|promoted|promotions?|sponsor\w*|side-?bar\w*|menu|menus|nav|navbar|navigation|foot|footer\w*|masthead|top-?bar|cookies?|consent|gdpr|popup|modal|"
    r"share|sharing|related|recommend\w*|newsletter\w*|subscri\w*|signup|login|breadcrumbs?|pagination|pager|paywall|skip-link)(?:$|[\s_-])",
    re.I,
)
_COMMENT_NAME = re.compile(r"(?:^|[\s_])(?:comments?|comment-?(?:list|area|section|form|body|content|thread|box|wrap\w*|item|text)|comments-?\w+|user-?comments?|reader-?comments?|disqus\w*|replies|respond)(?:$|[\s_-](?!free))", re.I)
_WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:header|notices?|alert|disclaimer|overlay|social|search\w*|widgets?|toolbar|legal|copyright|tags)(?:$|[\s_-])", re.I)
_TEXT_TAGS = frozenset("p li dt dd blockquote figure figcaption pre h1 h2 h3 h4 h5 h6 td th tr".split())
_RIGHTS = re.compile(r"©|\(c\)\s|copyright\s+(?:©|\(c\)|\d{4})", re.I)
_ENDS = re.compile(r"[.!?…:。！？।؟][\"'”’»)\]]*$")
_KEEP_NAME = re.compile(r"(?:^|[\s_-])(?:article|article-?(?:body|content|text)|post-?(?:body|content|text)|entry-?content|story|story-?body|main|main-?content|content|content-?body|body-?text)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar note".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)|<[/a-zA-Z][^<>]*+\Z|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


BAR, WEAK, KEEP, COMMENTS = "bar", "weak", "keep", "comments"


def hint_of(tag: str, attributes: str, inside: bool = False) -> str | None:
    """What an element tells of its text; ``inside``: it stands in an article. None if it does not tell."""
    bar, keep, weak = tag in _DROP_TAGS or (tag == "header" and not inside), tag in _KEEP_TAGS, tag == "header"
    if attributes.strip(" /"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        role = found.get("role", "").lower()
        if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")) or role in _DROP_ROLES:
            bar = True
        elif names and tag not in ("body", "html"):
            comments, barred = _COMMENT_NAME.search(names), _BAR_NAME.search(names)
            if tag in _TEXT_TAGS and tag not in ("li", "figure"):
                weak = weak or bool(comments or barred)
            elif comments:
                return COMMENTS
            else:
                bar = bar or bool(barred)
            weak = weak or bool(_WEAK_NAME.search(names))
            keep = keep or bool(_KEEP_NAME.search(names))
        keep = keep or role in ("main", "article") or found.get("itemprop") == "articleBody"
    return BAR if bar else KEEP if keep else WEAK if weak else None


def _standing(stack: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
    """barred, named, inside: the nearest telling element decides; one that only suggests lets those around it tell; comments hold whatever is in them."""
    named = False
    told = [h for _, h in stack if h]
    if COMMENTS in told:
        return True, False, False
    for h in reversed(told):
        if h == WEAK:
            named = True
        else:
            return h == BAR, named, h == KEEP
    return False, named, False


def blocks(page: str) -> list[tuple[str, bool, bool, bool, bool, int, int]]:
    """Flat blocks in page order: text, barred, named, inside, heading, words, words inside links."""
    out: list[tuple[str, bool, bool, bool, bool, int, int]] = []
    stack: list[tuple[str, str | None]] = []
    parts: list[str] = []
    linked: list[str] = []
    link, at, end, heading = 0, 0, len(page), False

    def flush() -> None:
        nonlocal linked, parts, heading
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                inside = len(html.unescape(" ".join(linked)).split())
                out.append((text, *_standing(stack), heading, text.count(" ") + 1, inside))
            parts, linked = [], []

    lowered = None
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            text = m[0]
            if text[0] != "<" or text == "<":
                parts.append(text)
                if link:
                    linked.append(text)
            elif text.startswith("<!--") and not text.endswith("-->"):
                break
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _INLINE:
            if tag == "a":
                link = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in _SKIP_TAGS and not closing:
            if attributes.rstrip().endswith("/") and tag not in _RAW_TAGS:
                continue
            lowered = page.lower() if lowered is None else lowered
            if len(lowered) != end:  # lower case of another length: search case by case
                found = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
                at = found.end() if found else end
            else:
                found_at = lowered.find(f"</{tag}", at)
                at = end if found_at < 0 else (page.find(">", found_at) + 1 or end)
            continue
        flush()
        link = 0
        if not closing:
            if stack and stack[-1][0] in ("p", "li", "dt", "dd", "option", "td", "th", "tr") and tag in (stack[-1][0], "p", "div", "ul", "ol", "table", "section", "article", "aside", "footer", "header", "nav", "form", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") and (stack[-1][0] == "p" or tag == stack[-1][0]):
                stack.pop()
            if tag not in _VOID and not attributes.rstrip().endswith("/"):
                stack.append((tag, hint_of(tag, attributes, tag == "header" and _standing(stack)[2])))
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        else:
            heading = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in ("p", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6") and stack[i][1] and stack[i][0] not in _TEXT_TAGS:
                    break  # a stray end tag does not close a telling container
    flush()
    return out


def features(found: list[tuple[str, bool, bool, bool, bool, int, int]]) -> list[tuple[float, ...]]:
    size = [(words, 100.0 * min(linked, words) / words) for *_, words, linked in found]
    around = [(0, 0.0), *size, (0, 0.0)]
    free = sum(b[5] - min(b[6], b[5]) for b in found if not b[1])
    held = sum(b[5] - min(b[6], b[5]) for b in found if b[3])
    region = held > 0 and 100 * held >= REGION * free
    out = []
    for i, (text, barred, named, inside, heading, _, _) in enumerate(found):
        after = i + 1 < len(found) and found[i + 1][3]
        own = (barred, named, inside, region and not inside and not barred, heading, bool(_ENDS.search(text)), bool(_RIGHTS.match(text)), after)
        out.append((*map(int, own), *around[i + 1], *around[i], *around[i + 2]))
    return out


def grow(rows: list[tuple[float, ...]], depth: int = DEPTH):
    """A CART node: a label, or (feature, limit, tree up to the limit, tree above it)."""
    labels = [r[-1] for r in rows]
    share = sum(labels) / len(rows)
    if depth == 0 or share in (0, 1):
        return int(share >= 0.5)
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            limit = (low + high) / 2
            sides = [[r[-1] for r in rows if r[f] <= limit], [r[-1] for r in rows if r[f] > limit]]
            if min(map(len, sides)) >= LEAST_ROWS:
                impurity = sum(len(s) * (p := sum(s) / len(s)) * (1 - p) for s in sides)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, limit)
    if best is None:
        return int(share >= 0.5)
    _, f, limit = best
    return (f, limit, grow([r for r in rows if r[f] <= limit], depth - 1), grow([r for r in rows if r[f] > limit], depth - 1))


def clear_cases() -> Iterator[tuple[float, ...]]:
    """Labelled rows that a rule can state: blocks without links, of several sizes, with a sentence's end or without, between all kinds of neighbours.

    Inside an article they are main text, beside or barred they are not; under a name that only suggests, sentences and
    long blocks are; where a page has no article, long sentences are, and shorter ones next to long blocks.
    """
    none, menu, long = (0, 0), (2, 100), (30, 0)
    for words, ends, before, after in product((2, 7, 12, 50), (0, 1), (none, menu, long), (none, menu, long)):
        size = (words, 0, *before, *after)
        yield (0, 0, 1, 0, 0, ends, 0, int(after != none), *size, 1)
        yield (0, 1, 1, 0, 0, ends, 0, int(after != none), *size, int(words >= 20 or (ends and words >= 5)))
        yield (0, 0, 0, 1, 0, ends, 0, 0, *size, 0)
        yield (1, 0, 0, 0, 0, ends, 0, 0, *size, 0)
        if ends and (words >= 20 or (words >= 10 and long in (before, after))):
            yield (0, 0, 0, 0, 0, ends, 0, 0, *size, 1)


@cache
def tree():
    return grow([*(tuple(map(float, line.split())) for line in LABELLED.strip().splitlines()), *clear_cases()])


def is_main(row: tuple[float, ...]) -> bool:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return bool(node)


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n\n".join(b[0] for b, row in zip(found, features(found), strict=True) if is_main(row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
