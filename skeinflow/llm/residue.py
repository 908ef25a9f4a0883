"""Template residue, filler, error pages and script notices in place of content.

Nothing here is a list of known sentences. Placeholders are found by one grammar per
delimiter; whether a hit is unfilled or only spoken of is weighed from its slot, from
words about templates beside it, in its sentence and per 100 words of its paragraph
(density), and from code marks around it. Error pages, script notices and stubs are
found by classes of words: a sentence gets points for the classes it joins (a thing
and its failure, scripts and a demand), for the way it addresses a reader and for
standing alone, and loses points for what only a report has (actors, counts, times,
clauses of cause). Filler is found by repetition, struck keys and prose without the
function words of any language.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from operator import eq

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("placeholder", "filler", "error", "script_notice")

CONTEXT = 2000

#: Section marks that open lines of graph texts, and tokenizer marks, which stand anywhere. Both look like bracketed placeholders.
SECTION_MARKS = ("FLOW", "EDGE", "PACKET", "HEX", "TOKENS", "NOTE")
TOKENIZER_MARKS = ("PAD", "UNK", "CLS", "SEP", "MASK", "BOS", "EOS")
#: Bracketed marks that logs and editors set, and TCP flags.
LOG_MARKS = ("INFO", "WARN", "WARNING", "ERROR", "DEBUG", "TRACE", "FATAL", "OK", "FAIL", "FAILED", "PASS", "SKIP", "SIC", "EDIT", "PDF", "SYN", "ACK", "FIN", "RST", "PSH", "URG")

_NAME = r"[^\W\d_]\w*(?:[ ._-]\w+){0,4}"
_PATH = r"[@.]?[^\W\d_][\w.@]*"
_CAPS = r"[A-Z][A-Z0-9]+(?:[_.][A-Z0-9]+){0,4}"
_ORDER = r"(?:insert|enter|add|fill in|fill|your|the name of|điền|nhập|thêm|hier|to be)\b"
_ORDERED = r"\b(?:einfügen|eintragen|einsetzen|ergänzen|goes here|here|vào đây|tại đây|ở đây)"
#: Delimiter grammars: each takes a field name, never an expression such as 7*7.
PLACEHOLDERS = {
    "braces": rf"\{{\{{\{{?\s*{_NAME}(?:\s*\|\s*\w+)?\s*\}}?\}}\}}|\{{\{{[#/^>]\s*(?:if|unless|each|with)?\s*{_PATH}\s*\}}\}}",
    "dollar_brace": rf"[$#]\{{\s*{_NAME}\s*\}}",
    "brace": rf"(?<![\w$#{{%])\{{{_NAME}\}}(?!\}})",
    "statement": rf"\{{%-?\s*{_NAME}\s*-?%\}}",
    "server_tag": rf"<%=?\s*{_PATH}(?:[ ._-]\w+){{0,4}}\s*%>",
    "format": rf"%\({_NAME}\)[sdf]",
    "dollars": r"\$(?=[A-Z0-9_.]*[A-Z])[A-Z][A-Z0-9_.]+\$",
    "percents": r"(?<![\w%])%[A-Z][A-Z_.]{2,}%(?!\w)",
    "ats": rf"@@{_NAME}@@|##{_CAPS}##",
    "angles": rf"<<\s*{_NAME}\s*>>",
    "angle_caps": rf"<{_CAPS}>",
    "angle_order": rf"<(?i:{_ORDER})[^<>\n]{{1,60}}>|<[^<>\n]{{1,60}}(?i:{_ORDERED})>|<[a-z]+(?: [a-z]+){{1,3}}>",
    "double_squares": rf"\[\[\s*{_NAME}\s*\]\]",
    "square_order": rf"\[(?i:{_ORDER})[^\[\]\n]{{1,60}}\]|\[[^\[\]\n]{{1,60}}(?i:{_ORDERED})\]|\[[A-Z][a-z]+(?: [A-Z][a-z]+){{1,3}}\](?![(\w])",
    "square_caps": rf"(?<!\[)\[{_CAPS}(?: [A-Z]{{2,}}){{0,3}}\](?![\](])",
    "underscored": r"(?<![\w])__[A-Z](?:[A-Z0-9.]|_(?!_))*__(?!\w)",
    "blank": r"_{4,}\s*\([^()\n]{2,60}\)",
    "to_do": r"\((?:TODO|TBD|FIXME|OFFEN|CẦN BỔ SUNG)\s*:[^()\n]{2,60}\)|\((?i:to be (?:completed|added|determined|defined|filled in))\)|\b(?:TBD|TODO)\s+[-–:]\s+[^\W\d_]\w*|(?m:(?<=: )(?:TBD|TBA|TODO)$)",
}
_PLACEHOLDER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PLACEHOLDERS.items()))
_ONE_WORD = re.compile(r"(?m)^\s*[^\W\d_][\w ]{1,30}:\s*(<(?!(?:a|b|i|p|u|s|br|hr|li|ul|ol|td|tr|th|em|h[1-6]|div|img|pre|code|span|body|html|head|table|strong|small|title|form|input)>)[a-z]{3,20}>)\s*$")
#: One of these, or what the two patterns take, is in every text with a placeholder.
_MAYBE = ("{", "<", "@@", "##", "$", "__", "TODO", "TBD", "TBA", "FIXME", "OFFEN", "BỔ SUNG", "(to be ", "(To be ")
_MAYBE_PERCENT = re.compile(r"%[(A-Z]")
_MAYBE_SQUARE = re.compile(r"\[(?:(?!(?:FLOW|EDGE|PACKET|HEX|TOKENS|NOTE)\])|(?<=[^\n]\[))")

#: Words about templates, programs and manuals, by which a sentence talks about a placeholder.
_META = re.compile(
    r"\b(?:templates?|templating|placeholders?|variables?|syntax|expressions?|interpolat\w+|format strings?|mappings?|tags?|filters?|arguments?|parameters?|attributes?|propert(?:y|ies)|macros?|engines?|escap\w+|delimiters?"
    r"|braces|renders?|rendered|renderers?|exporters?|expand\w*|substitut\w+|replaces?|replaced|binds?|documentation|manuals?|man page|tutorials?|for example|e\.g\.|such as|guides?|notation|command line|strings?|literals?|lookups?|loggers?|logging"
    r"|jinja2?|erb|mustache|handlebars|liquid|django|angular|vue|react|twig|freemarker|velocity|ansible|helm|bash|shell|ruby|python|perl|php|latex"
    r"|vorlagen?|platzhalter\w*|variablen?|ausdr[uü]ck\w*|ersetz\w*|(?:format)?zeichenketten?|ausgefüllt|handbuch|beispielsweise|exporter\w*"
    r"|mẫu|(?<!cảm )biến|cú pháp|chuỗi định dạng|được thay|thay thế|trình kết xuất|tài liệu hướng dẫn|chẳng hạn)\b",
    re.I,
)
#: Verbs that take a string as their object, right before it.
_MENTION = re.compile(r"\b(?:writes?|writing|written|types?|typing|uses?|using|sent|sends|send|tried|contain(?:s|ed|ing)|held|holds|with|as in|like|reads|takes?|schreibt|schreiben|enthielt|enthält|verwendet|schickte|gửi|chứa|viết|dùng)(?: the| a)?\W*$", re.I)
_SLOT = re.compile(r"[^\W\d_][^:.!?\n]{0,40}:\s*$|^\W*$")
_QUOTES = (("`", "`"), ('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("'", "'"))

#: Word classes of messages that a page shows to its reader, in English, German and Vietnamese.
_CLASS = {
    "script": r"java ?script|\bscripts?\b|\bscripting\b|\bskripte?n?\b|tập lệnh",
    "browser": r"\bbrowsers?\b|\btrình duyệt\b",
    "need": r"\bmust be\b|\bneeds?\b|\brequire[sd]?\b|\bnecessary\b|\bworks? (?:only|best) with|\bensure\b|benötig\w*|erforderlich|\bnötig|\bmüssen\b|\bmuss\b|\bbraucht\b|\berfordert\b|nur mit|\bcần\b|yêu cầu|đòi hỏi|\bphải\b",
    "on": r"\benabl(?:e|ed|ing)\b|(?:turn|switch)(?:ed)?(?: \S+){0,2} on\b|turn on|\bactivat(?:e|ed)\b|\ballow(?:ed)?\b|aktivier\w*|einschalt\w*|eingeschaltet\w*|schalten\b.{1,30}\bein\b|erlauben|zulassen|\bbật\b|kích hoạt|cho phép",
    "off": r"\bdisabled\b|(?:turned|switched) off|\bto be off\b|\bblocked\b|\bunsupported\b|\bnot (?:available|supported|enabled|allowed)\b|(?:does|do)(?: not|n't)(?: \w+)? (?:support|recogni[sz]e|run)\b|(?:out of date|outdated)|deaktiviert|ausgeschaltet|abgeschaltet|blockiert|gesperrt|unterstützt\b.{1,40}\b(?:nicht|keine?)\b|unterstützt keine?|veraltet|\btắt\b|không hỗ trợ|không chạy|đã cũ",
    "without": r"\bwithout\b|\bohne\b|nếu không|không có",
    "status": r"(?:\b(?:http|error|status|lỗi|fehler)\b[ :]*){0,2}\b[45]\d\d\b(?:\W{0,3}(?:\(?(?:bad request|unauthorized|forbidden|not found|request time-?out|too many requests|internal server error|server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)\)?))|(?:\b(?:http )?(?:error|lỗi|fehler)(?: code)?|serverfehler|máy chủ nội bộ)[ :(#]*[45]\d\d\b|^(?:bad request|forbidden|not found|unauthorized|bad gateway|gateway time-?out|service unavailable|too many requests|internal server error)\b|\berr_[a-z_]{4,}",
    "thing": r"\b(?:pages?|sites?|website|servers?|services?|requests?|requested|resources?|url|link|sessions?|connection|content|video|account|database|gateway|specified \w+|documents?|results?|comments?|token|credentials|app(?:lication)?|console|report|system|view(?:er)?|login|item|product|payment|data|files?|article|image|download|upload|profile|network|host|device|order|form)\b|\b(?:seite|server|\w*dienst|sitzung|verbindung|datenbank|anfrage|website|inhalte?|angebot|anwendung|datei|daten|konto|artikel|netzwerk|verweis)\b|\b(?:trang|máy chủ|dịch vụ|phiên|kết nối|yêu cầu|nội dung|hệ thống|dữ liệu|tệp|tài khoản|liên kết)\b",
    "fail": r"(?:could|can|was|were|is|be|are|did|do|does)(?: not|n't|not|'t)(?: be)?(?: \w+ly)? (?:found|find|displayed|shown|reach(?:ed)?|load(?:ed)?|process(?:ed)?|complete[d]?|handled?|work(?:ing)?|available|provided|query|access(?:ed)?|open(?:ed)?|connect(?:ed)?|respond(?:ing)?|saved?|sent|send)\b|\btrouble \w+ing\b|\bsuspended\b|\bunreachable\b|\bunresponsive\b|\bcrashed\b|\bdisconnected\b|\bwent offline\b|\bnot found\b|(?:does|do)(?: not|n't) exist|(?:was|has been|been|is|were|or|have been)(?: \w+)? (?:moved|deleted|removed|renamed|closed|blocked|refused|reset)\b|\b(?:has )?expired\b|\btimed out\b|too long to respond|\bunavailable\b|no longer available|\bfailed\b|\bunable to\b|\b(?:is|are) down\b|down for maintenance|technical difficulties|\binvalid\b|\bbroken\b|there is a problem|rate limit exceeded|(?:internal|encountered an?) error|error establishing|nicht (?:\w+ )?(?:gefunden|erreichbar|verfügbar|verarbeitet)|existiert nicht|abgelaufen|fehlgeschlagen|gescheitert|beendet|abgebrochen|unterbrochen|überlastet|gesperrt|nicht (?:geladen|geöffnet|angezeigt|gespeichert)|không (?:tìm thấy|tồn tại|khả dụng|hoạt động|thể (?:truy cập|tải|mở|kết nối|hiển thị)|(?:\S+ ){1,3}được)|quá tải|bị khóa|đã bị xóa|hết hạn|hết thời gian|thất bại|đang bảo trì|gián đoạn|có lỗi",
    "oops": r"^(?:\w+ ){0,2}error\W*$|\berror (?:has )?occurred|(?:something|that) (?:went|has gone) wrong|something broke|\b(?:critical|unexpected|internal) error\b|that's an error|\baccess denied\b|\bpermission denied\b|\blogin required\b|too many (?:\w+ ){0,2}(?:requests|queries|attempts)|not (?:authori[sz]ed|permitted) to|(?:no|not have|n't have) (?:right|rights|permission|access)\b|been blocked\b|must be logged in|fehler ist aufgetreten|schief ?gelaufen|zugriff (?:verweigert|abgelehnt)|keine berechtigung|müssen angemeldet|zu viele anfragen|xảy ra lỗi|lỗi (?:đã )?xảy ra|gặp sự cố|không có quyền|từ chối truy cập|truy cập bị từ chối|quá nhiều yêu cầu",
    "advice": r"\btry (?:again|later)|\bretry\b|\breload\b|\brefresh\b|(?:sign|log) ?in\b|contact (?:the |your )?(?:site|admin|support|owner)|go back|check (?:back|your)|be back|back (?:to|shortly)|\bwait (?:a |\d)|before trying|we have been notified|das ist alles|erneut|neu laden|laden sie|melden sie sich|warten sie|später|thử lại|tải lại|đăng nhập|quay lại",
    "purpose": r"to (?:view|see|use|continue|access|display|proceed|run|open|load)\b|in order to|for full|um (?:\S+ ){0,4}(?:zu|fort|anzu)|fortzufahren|anzuzeigen|zum anzeigen|zu (?:sehen|öffnen|nutzen)|để (?:xem|tiếp tục|hoạt động|sử dụng|mở|hiển thị|dùng)|mới hiển thị",
    "address": r"(?i:\bplease\b|\byou(?:r|'re)?\b|\bbitte\b|\bvui lòng\b|\bhãy\b|\bbạn\b|\bxin\b|\bmời\b)|\bSie\b|\bIhr\w{0,2}\b|\bIhnen\b",
    "sorry": r"\bsorry\b|\boops\b|\bwhoops\b|\bups\b|\bleider\b|xin lỗi|rất tiếc",
    "here": r"\b(?:this|the requested|our) (?:[\w-]+ ){0,2}(?:site|page|app(?:lication)?|website|server|content|video|form|map|player|feature|view(?:er)?|console|dashboard|browser|editor|report|case|request|action|explorer)\b|\bdiese[rsnm]? (?:\w+-?)?(?:seite|website|anwendung|ansicht|inhalte?|karte|funktion)\b|\bnày\b|\bthat's all\b",
    "ref": r"\b(?:request|reference|ref|error|trace|incident|ray)(?: ?id| code| number)?[ :#]+\w*\d\w*|\bkennung\b|\bmã yêu cầu\b|\brequestid\b",
    "stub_noun": r"(?:example|sample|dummy|placeholder|filler|stand-in|test|blind|beispiel|platzhalter)[ -]?(?:text|paragraph|section|heading|content|title|entry|absatz|inhalt|eintrag|überschrift)\w*|\b(?:stand-in|placeholder|dummy)\b|(?:văn bản|nội dung|đoạn)(?: \S+){0,3} (?:mẫu|giữ chỗ|thử)|giữ chỗ|als (?:ersatz|platzhalter)|blindtext|platzhalter",
    "order": r"^\W*(?:please |bitte |vui lòng |hãy |click here to )?(?:write|insert|add|enter|type|put|describe|replace|edit|fill in|viết|nhập|thêm|thay|điền|(?:schreiben|ergänzen|ersetzen|fügen|tragen) sie)\b|\b(?:schreiben|einfügen|eintragen|ergänzen|einsetzen|austauschen|ersetzen)\W*$",
    "body": r"\b(?:texts?|summary|content|description|introduction|title|body|paragraph|something|section|heading|wording|article|details|abstract|beschreibung|text|zusammenfassung|absatz|inhalt|kurzfassung)\b|tóm tắt|nội dung|mô tả|văn bản|đoạn|phần\b",
    "place": r"\bhere\b|in this (?:place|section|field|box|space)|in its place|own (?:text|words)|\btại đây\b|\bở đây\b|\bvào đây\b|\bhier\b|an dieser stelle|diese[rsnm]? stelle|goes here",
    "pending": r"coming soon|under construction|to be (?:added|written|completed|replaced|announced|determined|exchanged)|will (?:follow|be (?:replaced|added|written))|to follow\b|no content yet|left blank|\bfolgt(?=\W*$| in kürze| später| bald| demnächst| noch)|im aufbau|(?:wird|werden) (?:\w+ )?(?:ersetzt|ergänzt|ausgetauscht)|noch (?:aus|er)\w+ werden|(?:sẽ|đang) được (?:cập nhật|xây dựng|thay|bổ sung)|before the (?:report|text) is sent|vor dem versand|please ignore",
}
#: Looked for in lower case, but for ``address``: capitals tell the German polite form from "she" and "they".
_IS = {k: re.compile(v) for k, v in _CLASS.items()}
#: What only a report has: actors, counted things and addresses, times, clauses of cause, definitions.
_REPORT = tuple(
    re.compile(p)
    for p in (
        r"(?<!your )(?<!the site )\b(?:attackers?|intruders?|malware|bots?|clients|customers|users|user was|visitors?|teams?|analysts?|operators?|vendors?|authors?|designers?|printers|administrators|contractor|scanners?|crawlers?|probes?|sensors?|desk|shift|staff|victims?|witness|phishing|exploits?|patch(?:es)?|board|policy|linting|(?:build|mail|proxy|upload)\b(?! failed)|angreifers?|kunden|prüfer|dienstleister\w*|opfers?|gestaltern?|nhóm|kẻ tấn công|nạn nhân|người|máy tự động)\b",
        r"\b\d{1,3}(?:\.\d{1,3}){3}\b|\bflow_\w+|\bcap-\d|\b(?:\d[\d,.]*|two|three|four|all) (?:of\b|%|requests|times|clients|bots|visitors|flows|packets|hosts|connections|hours|replies|mal\b|yêu cầu|lần|máy|gói|verbindungen|stunden)",
        r"\bon (?:mon|tues|wednes|thurs|fri|satur|sun)day|\blast (?:week|night|month|year)|\byesterday\b|\bin (?:19|20)\d\d|\bfor (?:\w+ )?(?:hours|days)|\bbetween \d|\bat \d\d:\d\d|\bduring\b|\btwice\b|\bin spring\b|\buntil (?:mon|tues|wednes|thurs|fri)day|\bsince\b|\bam (?:mon|diens|donners|frei)tag|\bseit\b|hôm qua|tối qua|tuần sau|thứ (?:hai|ba|tư|năm)|trong (?:hai|ba) giờ",
        r", (?:so|which|because|while|as|and) (?!the player|please|try)|\bbecause\b|\bwhich\b|\band (?:then|each|its|it|no|we|she|he|was|handled|opens|fixes|pulled|closed|repeated)\b|, (?:weil|denn|was|das|die|der) |\bnên\b|\bvì\b|\brồi\b|\bif the\b|\bonce the\b|\bafter (?:the|an?)\b|\bwhen\b",
        r"\b(?:is|are|was) (?:an?|the most|how|what|the advice) |\bmeans\b|\boccurs\b|\bconsists\b|\brecommends?\b|\bdient\b|\blà ngôn\b|\bgiúp\b|\bshows\b|\bist ein|\bwird seit|\bbefindet sich im aufbau der",
        r"\b(?:answered|rose|recovered|complained|appeared|stopped|reduced|redirects?|replied|returned \d|shed|helped|were \w+ed|that (?:failed|were|was)|erschien|behoben|xuất hiện|đã sửa|trả lời)\b",
    )
)
_TRACE_LINE = re.compile(
    r"^\s*(?:traceback \(most recent call last\)|file \".{1,200}\", line \d+|at [\w$.<>]+(?: ?\(|$)|caused by: |goroutine \d+|(?:unhandled exception: |uncaught |exception in thread .{1,40}? )?(?:[A-Za-z_$][\w$]*\.)*[A-Z]\w*(?:Exception|Error)\b\s*(?::|$)"
    r"|panic: |segmentation fault|(?:php )?(?:fatal error|parse error|warning|notice|deprecated): .{3,300}? (?:on line |in )\S+|[A-Z]{3}-\d{5}: |sqlstate\[|cannot (?:get|post|put|delete|patch) /\S*$|you have an error in your sql syntax)",
    re.I,
)
_MARKUP_ERROR = re.compile(r"^\s*(?:<[?!][^>]*>\s*)*<(?:html|error|response|fault)\b.{0,400}?(?:<title>\s*(?:error|fehler|lỗi)?\W*[45]\d\d\b|<title>[^<]*(?:error|not found|forbidden|denied|unavailable)|<code>|<message>)", re.I | re.S)
#: What may stand before the sentence itself on a page: tags, list numbers, a mark that opens a line.
_LEAD = re.compile(r"^(?:\s*<[^<>]{1,80}>|\s*\[[A-Z]+\]|\s*\d{1,2}\.\s|[\s>*#|-])+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“\n]{1,300}“|«[^»\n]{1,300}»|`[^`\n]{1,300}`|(?<!\w)'[^'\n]{1,300}'(?!\w)")
_SPLIT = re.compile(r"[.!?…][\"”’)]*\s+(?=[^\sa-zà-ỹ])|\n+")
_CONTINUES = re.compile(r"\W{0,2}(?:[a-zà-ỹ]|\d)")

_ODD = re.compile(r"<\|[a-z_]{2,20}\|>|</?(?:s|pad|unk|mask)>|\[(?:PAD|UNK|CLS|SEP|MASK|BOS|EOS)\]|[-=]{9,}|0{16,}|[​-‏ -‮⁠-⁤﻿�­]|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
#: One of these is in every printable text that ``_ODD`` matches.
_ODD_PARTS = ("<|", "</", "<s>", "<pad>", "<unk>", "<mask>", "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[BOS]", "[EOS]", "---", "===", "-=", "=-", "0" * 16, "\ufffd")
#: Frequent function words by language; prose of any length uses several of one language.
FUNCTION_WORDS = (
    frozenset("the of and to in is was were are be been that this it for on with as by at from or not which who an a no so if but than under before after into one same we you your its".split()),
    frozenset("der die das und zu im ist war sind ein eine einer nicht von mit auf für aus bei nach als auch dass es den dem des sich wir sie nur noch kein keine am in".split()),
    frozenset("và của là có không được cho các những này đã để từ trong với một khi chỉ chưa phải vì tại theo bị".split()),
    frozenset("le la les des du un une et est dans pour que qui pas sur en il au ce se ne".split()),
    frozenset("el los las una y en por con para que de la un se su al lo es no".split()),
    frozenset("il di che non sono per la un una le i con da del è e si al".split()),
)
#: The words of the printers' filler text.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split())
_KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm")
_REPEAT = re.compile(r"(?<!\w)((?:[^\W\d_]{2,15})(?: [^\W\d_]{2,15}){0,3})(?:[.,;:!]* +\1){4,}", re.I)
_FENCED = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(code|pre)\b[^>]*>.*?</\1>", re.S | re.I)


def normalise(text: str) -> str:
    """Without stray marks, control characters and tokenizer marks; blanks are single, line ends kept."""
    s = text.replace("\r", "\n")
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
    if not s.replace("\n", "").isprintable() or any(mark in s for mark in _ODD_PARTS):
        s = re.sub(r"[^\S\n]+", " ", _ODD.sub("", s))
    elif "  " in s:
        s = re.sub("  +", " ", s)
    if " \n" in s or "\n " in s:
        s = re.sub(r" *\n *", "\n", s)
    return s.strip()


def _outside_code(text: str) -> str:
    """Fenced and tagged code blocks become blank, line ends kept."""
    if "```" not in text and "~~~" not in text and "</" not in text:
        return text
    return _FENCED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _quoted(sentence: str, start: int, end: int) -> bool:
    """Whether the place lies between a pair of quotes or backticks that opens before and closes after it."""
    for left, right in _QUOTES:
        if left == "'":
            if sentence[max(0, start - 1) : start] == "'" and sentence[end : end + 1] == "'":
                return True
            continue
        before, after = sentence[:start], sentence[end:]
        if left == right:
            if before.count(left) % 2 and right in after:
                return True
        elif before.rfind(left) > before.rfind(right) and right in after:
            return True
    return False


def _sentences(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for m in _SPLIT.finditer(text):
        sentence = text[at : m.end()].rstrip()
        if sentence:
            yield at, sentence
        at = m.end()
    if at < len(text):
        yield at, text[at:]


#: Nothing, or a short stray run that touches the mark: a line that a section mark opens, though noise got in before it.
_STRAY = re.compile(r"(?:[^\[\]]{0,23}(?:\w|[^\x00-\x7f]))?")


def _spoken_of(line: str, start: int, end: int, tutorial: bool) -> bool:
    """Whether the placeholder at ``line[start:end]`` is the topic of its sentence rather than a gap in it.

    Words about templates weigh 1 each in the sentence and 1.5 right beside the placeholder, a
    verb that takes a string as its object 1 right before it, a tutorial around it 1; a slot of its own
    (after a label, or nothing else on the line) weighs 1.5 against that.
    """
    at, sentence = next(((a, s) for a, s in _sentences(line) if a <= start < a + len(s)), (0, line))
    left, right = line[at:start], line[end : at + len(sentence)]
    near = " ".join(left.split()[-3:]) + " | " + " ".join(right.split()[:3])
    beside = len({m.lower() for m in _META.findall(near)})
    total = len({m.lower() for m in _META.findall(left + " | " + right)})
    weight = total + 0.5 * min(beside, 1) + (1 if _MENTION.search(left) else 0) + (1 if tutorial else 0)
    return weight - (1.5 if _SLOT.fullmatch(left) and not re.search(r"\w+ \w+ \w+", right) else 0) >= 1.5


def _may_hold_placeholder(text: str) -> bool:
    return any(m in text for m in _MAYBE) or "%" in text and bool(_MAYBE_PERCENT.search(text)) or "[" in text and bool(_MAYBE_SQUARE.search(text))


def _placeholder(text: str, raw: str) -> bool:
    """Whether a placeholder is left unfilled: not quoted, not code, not a mark, not spoken of."""
    if not _may_hold_placeholder(text):
        return False
    hits, begin = [], 0
    for line in text.split("\n"):
        if _may_hold_placeholder(line):
            hits += [(begin + m.start(), begin + m.end(), m.lastgroup) for m in _PLACEHOLDER.finditer(line)]
            hits += [(begin + m.start(1), begin + m.end(1), "angle_word") for m in _ONE_WORD.finditer(line)]
        begin += len(line) + 1
    for start, end, kind in hits:
        begin = text.rfind("\n", 0, start) + 1
        stop = text.find("\n", end)
        # Context is the line, of a very long one what lies within ``CONTEXT`` characters, so a text of one line and many hits takes no square of time.
        opens, begin = begin, max(begin, start - CONTEXT)
        line = text[begin : min(stop if stop >= 0 else len(text), end + CONTEXT)]
        if kind == "square_caps":
            mark = text[start + 1 : end - 1].replace(" ", "")
            if mark in TOKENIZER_MARKS or mark in LOG_MARKS or (mark in SECTION_MARKS and _STRAY.fullmatch(text, opens, start)):
                continue
        if _quoted(line, start - begin, end - begin):
            continue
        # Density: a paragraph of a tutorial holds 4 words about templates or more in 100, or code marks beside them.
        n_meta = len(_META.findall(line))
        tutorial = n_meta >= 3 and 100 * n_meta >= 4 * len(line.split()) or (n_meta > 0 and len(hits) < 4 and ("```" in raw or line.count("`") >= 2))
        if not _spoken_of(line, start - begin, end - begin, tutorial):
            return True
    return False


def _struck(word: str) -> bool:
    """Whether a word is a run along a row of keys, one letter over and over, or holds no vowel."""
    if len(word) < 3:
        return False
    if len(set(word)) == 1 or not re.search(r"[aeiouyáàâäãåéèêëíìîïóòôöõúùûüæœ]", word):
        return True
    return any(word in row for row in _KEY_ROWS)


def _babble(paragraph: str) -> bool:
    """A stretch of plain words that hardly uses the function words of any language: pseudo-Latin or keys struck at random.

    A list is none: without a full stop, or with commas after many words, it needs struck keys.
    """
    lower = paragraph.lower().split()
    if len(lower) < 10 or any(len(language.intersection(lower)) >= 4 for language in FUNCTION_WORDS):
        return False
    words = paragraph.split()
    plain = [w.strip(".,;:!?").lower() for w in words]
    alphabetic = [w for w in plain if w.isalpha() and w.isascii()]
    if len(alphabetic) < 10 or len(alphabetic) < 0.95 * len(plain):
        return False
    distinct = set(alphabetic)
    if max(len(distinct & language) for language in FUNCTION_WORDS) >= (2 if len(alphabetic) < 16 else 4):
        return False
    if 10 * sum(map(_struck, alphabetic)) >= 3 * len(alphabetic):
        return True
    return paragraph.rstrip()[-1:] in ".!?" and 10 * paragraph.count(",") < 4 * len(words)


def _filler(text: str) -> bool:
    lower = text.lower()
    flat = text.replace("\n", " ")
    words = lower.replace(".", "").replace(",", "").replace(";", "").replace(":", "").replace("!", "").split()
    if any(sum(map(eq, words, words[p:])) >= 4 * p for p in (1, 2, 3, 4)):
        for m in _REPEAT.finditer(flat):
            if not re.fullmatch(r"[a-f ]+", m.group(1)):
                return True
    for paragraph in text.split("\n"):
        if paragraph and _babble(paragraph):
            return True
    if "ipsum" in lower or "dolor" in lower:
        for _, s in _sentences(text):
            words = [w.strip(".,;:!?\"").lower() for w in s.split()]
            spread = max((len(language.intersection(words)) for language in FUNCTION_WORDS), default=0)
            named = s.lower().find("lorem ipsum")
            if named >= 0 and not _quoted(s, named, named + 11) and spread < 3:
                return True
            if len(words) >= 6 and 10 * sum(w in LOREM for w in words) >= 6 * len(words):
                return True
    return False


#: Parts of words without which no message of the kind can be; a sentence without any is not weighed for it.
_STEMS = {
    1: "script|skript|tập lệnh|browser|trình duyệt",
    2: "error|fehler|lỗi|not found|n't |'t |cannot|could not|unable|unavailable|not available|no longer|wrong|broke|denied|expired|timed out|too long|been moved|was moved|deleted|been removed|was removed|removed|forbidden|did not|does not|"
    "too many|not authori|permission|logged in|log in|sign in|login|no right|blocked|failed|invalid|maintenance|difficult|bad gateway|bad request|time-out|gateway timeout|request timeout|err_|unauthorized|not exist|rate limit|credential|is down|oops|ups,|"
    "trouble|suspended|unreachable|unresponsive|crashed|disconnected|offline|nicht |abgelaufen|gescheitert|schlagen|beendet|abgebrochen|unterbrochen|überlastet|gesperrt|berechtigung|anfragen|verweigert|abgelehnt|schief|"
    "không |hết |thất bại|bảo trì|quá tải|bị khóa|gặp sự cố|quyền|đăng nhập|gián đoạn|bị xóa|quá nhiều",
    4: " here|here.|coming soon|construction|to be |follow|no content|left blank|stand-in|placeholder|dummy|sample|example|test |testeintrag|in this |own text|ignore|type the|insert |filler|"
    "folgt|im aufbau|ersetz|ausgetausch|hier|stelle|platzhalter|blind|beispiel|mẫu|giữ chỗ|tại đây|ở đây|vào đây|sẽ được|đang được|thay",
}
_STEM_TREE = ahocorasick.Automaton()
for _bit, _words in _STEMS.items():
    for _stem in _words.split("|"):
        _STEM_TREE.add_word(_stem, _bit)
_STEM_TREE.make_automaton()


class _Classes(dict):
    """The word classes of a sentence, each looked for when first asked after."""

    def __init__(self, sentence: str):
        self.sentence, self.lower = sentence, sentence.lower()

    def __missing__(self, name: str) -> re.Match | None:
        found = self[name] = _IS[name].search(self.sentence if name == "address" else self.lower)
        return found


def _points(sentence: str, kinds: int, alone: bool, opening: bool, only: bool, following: str) -> str | None:
    """The kind of message a sentence is, by the points of its word classes (2 are needed), or None.

    ``kinds``: what its stems allow (1 notice, 2 error, 4 stub).
    ``alone``: it fills its line; ``opening``: it opens a text of at most 40 words; ``only``: it is the whole text; ``following``: the sentence after it.
    """
    s = _LEAD.sub("", _TAG.sub(" ", sentence)).strip()
    if not s:
        return None
    s = _QUOTED.sub(" Q ", s)
    has = _Classes(s)
    low = has.lower
    failure = kinds & 2 and (has["thing"] and has["fail"] or has["oops"] or has["status"] or (has["purpose"] or has["thing"]) and has["advice"])
    scripts = kinds & 1 and (has["script"] or has["browser"])
    unwritten = kinds & 4 and (has["stub_noun"] or has["pending"] or has["body"])
    if not (failure or scripts or unwritten):
        return None
    n_words = len(s.split())
    manner = (0.5 if alone and n_words <= 6 else 0) + (0.5 if alone or opening else 0) + (0.5 if only and n_words <= 20 else 0) + (0.5 if has["address"] else 0)
    report = sum(1 for p in _REPORT if p.search(low))

    notice = 0.0
    if not scripts:
        pass
    elif has["script"] and (has["need"] or has["on"] or has["off"] or has["without"]):
        notice = 1 + (0.5 if has["script"].start() == 0 or has["on"] and has["on"].start() < 8 else 0)
    elif has["browser"] and has["address"] and (has["off"] or re.match(r"\W*(?:just a moment\W+)?checking", low)):
        notice = 1.5
    if notice:
        notice += manner + (0.5 if has["script"] and has["browser"] else 0) + (0.5 if _IS["purpose"].search(following.lower()) else 0) + (1 if has["here"] else 0) + (0.5 if has["purpose"] else 0) - report
        if notice >= 2:
            return "script_notice"

    error = 0.0
    if failure and has["status"]:
        rest = low[has["status"].end() :]
        goes_on = _CONTINUES.match(rest) and not re.match(r"\W*\(", rest)
        error += 2 if not goes_on or has["fail"] and not report else -0.5
        if has["status"].start() > 30:
            error -= 1
    if failure and has["thing"] and has["fail"]:
        error += 1
    if failure and has["oops"]:
        error += 1.5
    if failure and has["sorry"] and not error:
        error += 0.5 if has["advice"] or has["thing"] else 0
    if failure and has["advice"] and (error or has["purpose"] or has["thing"] and n_words <= 6):
        error += 1
    elif error and (_IS["advice"].search(following.lower()) or _IS["ref"].search(following.lower())):
        error += 0.5
    if error > 0:
        error += manner + (0.5 if has["here"] else 0) + (1 if has["sorry"] else 0) + (0.5 if has["ref"] else 0) + (0.5 if has["purpose"] else 0) - report
        if error >= 2:
            return "error"

    if not unwritten:
        return None
    stub = (1 if has["stub_noun"] else 0) + (1 if has["pending"] else 0)
    if has["order"] and has["body"]:
        stub += 1 + (0.5 if has["place"] else 0)
    elif has["place"] and has["body"] and (has["address"] or re.search(r"\b(?:goes|comes|belongs) here\b|\b(?:steht|kommt|gehört)\b", low)):
        stub += 0.5 + (0.5 if n_words <= 6 else 0)
    if stub:
        stub += manner + (0.5 if re.match(r"\W*(?:this|these|diese?[rs]?|dies|đây|đoạn này|the final)\b", low) else 0) + (0.5 if has["place"] else 0) - report
        if stub >= 2:
            return "filler"
    return None


def _messages(text: str) -> str | None:
    lower = text.lower()
    if len(lower) != len(text):  # some capitals become two characters
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    hits = list(_STEM_TREE.iter(lower))
    if not hits:
        return None
    parts, k, n_words = list(_sentences(text)), 0, None
    for i, (at, s) in enumerate(parts):
        stop, kinds = at + len(s), 0
        while k < len(hits) and hits[k][0] < stop:
            if hits[k][0] >= at:
                kinds |= hits[k][1]
            k += 1
        if not kinds:
            if k == len(hits):
                return None
            continue
        if i <= 1 and n_words is None:
            n_words = len(text.split())
        alone = (at == 0 or text[at - 1] == "\n") and (stop == len(text) or text[stop] == "\n")
        found = _points(s, kinds, alone, i <= 1 and n_words <= 40, len(parts) == 1, parts[i + 1][1] if i + 1 < len(parts) else "")
        if found:
            return found
    return None


def _error_body(text: str) -> bool:
    """Whether the text as a whole is the body of an error: traces, error markup or an error object."""
    head = text[:1]
    if head == "{" and text.endswith("}"):
        try:
            got = json.loads(text)
        except ValueError:
            return False
        keys = {str(k).lower() for k in got}
        return bool(keys & {"error", "errors", "exception", "fault"} or keys and keys <= {"message", "detail", "status", "code", "documentation_url", "title", "type", "path", "timestamp"} and keys & {"message", "detail"})
    if head == "<" and _MARKUP_ERROR.match(text):
        return True
    lines = [line for line in text.split("\n") if line]
    traced = [bool(_TRACE_LINE.match(line)) for line in lines]
    return any(traced) and (traced[0] or 3 * sum(traced) >= len(lines))


def classify(text: str | None) -> str | None:
    """The kind of residue a text consists of or holds (one of ``KINDS``), or None.

    Null, empty and blank texts are none. The whole text is read, whatever its length.
    """
    if not text or text.isspace():
        return None
    plain = normalise(text)
    clean = _outside_code(plain)
    if _placeholder(clean, plain):
        return "placeholder"
    if _error_body(clean):
        return "error"
    return _messages(clean) or ("filler" if _filler(clean) else None)


def find_residue(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``residue``: the kind of residue, null for proper texts.

    One row per input row. Narrow: no shuffle, and only the named columns are read.
    """
    cols = list(keep)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[cols].copy()
            out["residue"] = pd.Series([classify(t) for t in b[text]], dtype="object", index=b.index)
            yield out

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "residue string"])
    return docs.select(*dict.fromkeys([*cols, text])).mapInPandas(run, schema)


def without_residue(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The corpus without texts that hold residue; null, empty and blank texts stay."""
    return find_residue(docs, text, keep).where(F.col("residue").isNull()).drop("residue")


def residue_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts per source and kind of residue (null: proper)."""
    return find_residue(docs, text, ("source",)).groupBy("source", "residue").agg(F.count(F.lit(1)).alias("n_documents"))
