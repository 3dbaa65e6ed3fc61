"""Token classes, permissible pairs and statement productions of the lexed languages.

A token class is one character. The pairs of a language follow from a few facts of its grammar: which classes may begin an
operand, which may end one, which join two operands, and what each keyword may stand next to. The table is bounded by the
grammars (some thousands of rows), whatever the corpus.

Classes: i name, n number, s string, N line end, V void token that fits nowhere (unterminated string or comment, stray
character, conflict mark); brackets, comma, semicolon, colon and dot for themselves; b binary operator, u prefix operator, d prefix
or binary operator, = assignment, p postfix operator, a arrow, q question mark, @ annotation mark, # attribute mark, and
capital or lower letters for groups of keywords as listed by language.
Further marks: ^ and $ begin and end a file; in Python H ends a line that opens a block, Y a decorator, + and - are indent and dedent.
"""

from __future__ import annotations

import re
from functools import cache

_NUMBER = r"0[xX][0-9a-fA-F_]+\w*|0[bBoO][01234567_]+\w*|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d+)?\w*|\.\d[\d_]*(?:[eE][+-]?\d+)?\w*"
_NAME = r"[^\W\d]\w*"
_CONFLICT = r"^(?:<{7}|>{7}|\|{7})(?![<>|])[^\n]*|^={7}(?=\r?$)"
_DQ, _SQ = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_LINE_COMMENT, _BLOCK_COMMENT = r"//[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"

#: Per language the token pattern, and classes of words and operators.
_LANGUAGES: dict[str, dict] = {
    "python": {
        "tokens": [
            r"\#[^\n]*", r"\\\r?\n",
            r"[rRbBuUfF]{0,2}(?:\"\"\"[^\"\\]*(?:(?:\\.|\"(?!\"\"))[^\"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''|" + r'"(?:[^"\\\n]|\\.)*"(?!"")|' + r"'(?:[^'\\\n]|\\.)*'(?!''))",
            _NUMBER, _NAME, r"->|:=|\.\.\.|(?:\*\*|//|<<|>>|[+\-*/%@&|^])=|\*\*|//|<<|>>|[<>=!]=",
        ],
        "words": {
            "K": "if while with", "F": "for", "D": "def", "C": "class", "B": "elif else except finally", "T": "try", "A": "async", "m": "match case type",
            "r": "return yield raise", "Z": "assert del global nonlocal", "e": "pass break continue", "I": "import", "J": "from", "o": "and or in is", "w": "as", "x": "not", "l": "lambda", "t": "await", "c": "None True False",
        },
        "operators": {"b": "// << >> <= >= == != % & | ^ < > :=", "d": "+ - * ** /", "u": "~", "=": "= += -= *= /= //= %= @= &= |= ^= <<= >>= **=", "a": "->", "c": "...", "@": "@"},
    },
    "javascript": {
        "tokens": [
            _LINE_COMMENT, _BLOCK_COMMENT, _DQ, _SQ, r"`[^`\\]*(?:\\.[^`\\]*)*`", r"(?<=[=(,:;!&|?{}\[\n+>])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*",
            _NUMBER, r"\#?[A-Za-z_$][\w$]*|" + _NAME, r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\*\*|[+\-*/%&|^]=|<<|>>",
        ],
        "words": {
            "D": "const", "v": "var", "F": "function", "C": "class", "E": "extends", "K": "if while switch", "H": "catch", "f": "for", "B": "else finally", "T": "try", "Q": "do", "r": "return throw", "y": "yield await", "k": "case", "g": "default", "e": "break continue debugger",
            "I": "import", "X": "export", "o": "in instanceof", "x": "typeof void delete", "w": "new", "c": "this super null true false", "h": "of from as async get set static let",
        },
        "operators": {"b": "=== !== == != <= >= && || ?? ** << >> >>> / % * & | ^ < >", "d": "+ -", "u": "! ~", "p": "++ --", "=": "= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=", "a": "=>", "q": "?", ".": "?.", "z": "..."},
    },
    "go": {
        "tokens": [
            _LINE_COMMENT, _BLOCK_COMMENT, _DQ, r"`[^`]*`", r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'", _NUMBER, _NAME,
            r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[+\-*/%&|^]=|<<|>>|&\^",
        ],
        "words": {
            "P": "package", "I": "import", "F": "func", "D": "var const type", "S": "struct interface", "M": "map chan", "K": "if for switch select", "B": "else", "k": "case", "g": "default", "r": "return", "v": "go defer",
            "R": "range", "e": "break continue fallthrough", "G": "goto",
        },
        "operators": {"b": "== != <= >= && || / % | << >> &^ < >", "d": "+ - * & ^ <-", "u": "! ~", "p": "++ --", "=": "= := += -= *= /= %= &= |= ^= <<= >>= &^=", "z": "..."},
    },
    "rust": {
        "tokens": [
            _LINE_COMMENT, r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/", r"b?r\"[^\"]*\"|b?r\#\"(?:[^\"]|\"(?!\#))*\"\#|b?r\#\#\"(?:[^\"]|\"(?!\#\#))*\"\#\#", r'[bc]?"[^"\\]*(?:\\.[^"\\]*)*"', r"b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))'", r"'[A-Za-z_]\w*",
            r"0[xX][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?\w*", r"r\#[A-Za-z_]\w*|" + _NAME, r"<<=|>>=|\.\.=|\.\.\.|\.\.|=>|->|::|==|!=|<=|>=|&&|\|\||[+\-*/%&|^]=|<<",
        ],
        "words": {
            "F": "fn", "D": "let const static", "M": "mut ref dyn move", "T": "struct enum union trait mod", "L": "impl", "U": "use", "V_": "", "P": "pub unsafe async extern crate_", "K": "if while match", "f": "for", "o": "in", "w": "as where", "B": "else", "Q": "loop",
            "r": "return break", "e": "continue", "y": "type",
        },
        "operators": {"b": "== != <= >= / % ^ << + > =>", "d": "- * & && | || < .. ..=", "u": "!", "=": "= += -= *= /= %= &= |= ^= <<= >>=", "a": "-> =>", "p": "?", "h": "::", "#": "#", "$": "$", "@": "@"},
    },
    "java": {
        "tokens": [
            _LINE_COMMENT, _BLOCK_COMMENT, r'"""[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""', _DQ, r"'(?:[^'\\\n]|\\[^\n]{1,6}?)'", _NUMBER, r"[A-Za-z_$][\w$]*|" + _NAME, r"<<=|>>=|\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|[+\-*/%&|^]=|<<",
        ],
        "words": {
            "P": "package", "I": "import", "m": "public private protected static final abstract native synchronized transient volatile strictfp default sealed", "C": "class interface enum", "E": "extends implements throws permits", "K": "if while switch", "H": "catch", "f": "for", "B": "else finally", "T": "try", "Q": "do", "r": "return throw assert", "k": "case",
            "y": "boolean byte char double float int long short void", "w": "new", "o": "instanceof", "e": "break continue", "c": "this super null true false", "R": "record module open",
        },
        "operators": {"b": "== != <= >= && || / % * & | ^ << < >", "d": "+ -", "u": "! ~", "p": "++ --", "=": "= += -= *= /= %= &= |= ^= <<= >>=", "a": "->", "q": "?", "h": "::", "z": "...", "@": "@"},
    },
    "json": {"tokens": [r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])", r"(?:true|false|null)(?!\w)"], "words": {"v": "true false null"}, "operators": {}},
    "toml": {
        "tokens": [r"\#[^\n]*", r'"""[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""', r"'''[^']*(?:'(?!'')[^']*)*'''", r'"(?:[^"\\\n]|\\.)*"(?!"")', r"'[^'\n]*'(?!'')", r"[+-]?(?:\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?)?(?:Z|[+-]\d\d:\d\d)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?|inf\b|nan\b|0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)(?![\w-])", r"[A-Za-z0-9_-]+"],
        "words": {"v": "true false"},
        "operators": {"=": "="},
    },
}
_CONTEXTUAL = "type interface enum namespace module declare readonly public private protected abstract implements override keyof infer is asserts satisfies unique accessor"
_LANGUAGES["typescript"] = _LANGUAGES["javascript"] | {"words": _LANGUAGES["javascript"]["words"] | {"h": _LANGUAGES["javascript"]["words"]["h"] + " " + _CONTEXTUAL}}
LANGUAGES = tuple(_LANGUAGES)


@cache
def token_pattern(language: str) -> re.Pattern:
    return re.compile("|".join([_CONFLICT, *_LANGUAGES[language]["tokens"], r"\n[ \t]*" if language == "python" else r"\n", r"[^\s\ufeff]"]), re.M | re.S)


class Classes(dict):
    """token -> class, filled as tokens come."""

    def __init__(self, language: str):
        spec = _LANGUAGES[language]
        super().__init__({"\n": "N" if language in ("python", "javascript", "typescript", "go", "toml") else ""})
        for group in (spec["words"], spec["operators"]):
            for c, words in group.items():
                self.update(dict.fromkeys(words.split(), c[0]))
        self.update({x: x for x in "()[]{},;:." if not (language == "json" and x in "();.") and not (language == "toml" and x in "():;")})
        if language == "python":
            self[";"] = ";"
        self.language, self.fixed = language, dict(self)

    def __missing__(self, t: str) -> str:
        c, lang = t[0], self.language
        if len(t) >= 7 and t[:7] in ("<<<<<<<", ">>>>>>>", "|||||||", "======="):
            k = "V"
        elif c == "\n":
            k = "N"
        elif (lang in ("python", "toml") and c == "#") or (lang not in ("python", "toml", "json") and t[:2] in ("//", "/*") and len(t) > 1) or (lang == "python" and c == "\\" and len(t) > 1):
            k = ""
        elif c == "'" and lang == "rust" and not t.endswith("'"):
            k = "l"
        elif len(t) > 1 and t[-1] in "\"'`" and (c in "\"'`rRbBuUfFc"):
            k = "s"
        elif c.isdigit() or (c in ".+-" and len(t) > 1 and (t[1].isdigit() or t[1:] in ("inf", "nan"))):
            k = "n"
            if lang == "python" and not re.fullmatch(r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?[\d_]*(?:[eE][+-]?\d+)?)[jJ]?", t):
                k = "V"
            elif lang == "toml" and re.search(r"[A-Za-z-]", t) and not re.fullmatch(r"0[xob][0-9a-fA-F_]+|[\d_.]+[eE][+-]?\d+|\d{4}-\d\d-\d\d.*", t):
                k = "i"
        elif lang in ("javascript", "typescript") and "/" in t and len(t) > 1:
            k = "s"
        elif c.isalpha() or c in "_$" or (lang in ("javascript", "typescript") and c == "#" and len(t) > 1) or (lang == "toml" and (c == "-" or c.isalnum())):
            k = "V" if lang == "json" else "i"
        else:
            k = "V"
        if len(self) < 200_000:
            self[t] = k
        return k


#: Classes of words that stand wherever those of another class do.
_LIKE = {"javascript": {"v": "D", "H": "K", "T": "B", "Q": "B"}, "java": {"H": "K", "T": "B", "Q": "B"}, "rust": {"Q": "B"}}
_LIKE["typescript"] = _LIKE["javascript"]


def _cross(left: str, right: str) -> set[str]:
    return {a + b for a in left for b in right}


@cache
def permissible_pairs(language: str) -> frozenset[str]:
    """Pairs of adjacent classes that some sentence of the language has."""
    pairs = _pairs(language)
    for new, old in _LIKE.get(language, {}).items():
        pairs |= {new + x[1] for x in pairs if x[0] == old} | {x[0] + new for x in pairs if x[1] == old}
    return pairs


def _pairs(language: str) -> frozenset[str]:
    if language == "json":
        ends = "snv]}"
        return frozenset(_cross("^[,:", "snv[{") | _cross(ends, ",]}$") | {"[]", "{}", "{s", "s:"})
    if language == "toml":
        value = "snv[{"
        ends = "snvi]}"
        return frozenset(_cross("N", "Nisn[v]},{") | _cross("=", value) | _cross("[,{", value + "i]}N") | _cross(ends, ",N]}.=") | _cross(".", "isnv") | {"nn", "]]", "^$"} | _cross("^", "Nisn[v") | _cross("Nisnv]}", "$") | _cross("n", ".="))
    if language == "python":
        start, end = "insc([{duxltm", "insc)]}m"
        first = start + "KFDCTAmrZeIJ@"
        pairs = _cross("bdo=,([{:uxta", start) | _cross(end, "bdo=,:;.)]}[(NwaKFB") - _cross("n", "(") | {"ss", "ox", "xo", "nN", "*"[:0]}
        pairs |= _cross("w", "i(c[dm") | _cross("r", start + "N;I)]},") | {"rr"[:0]} | _cross("Z", start) | _cross("e", "N;") | _cross("I", "i.cd(m") | _cross("i.cm", "I") | _cross("J", start + ".") | _cross(end + "r", "J") | _cross("m", start) | _cross(".", "im.") | _cross("D", "im") | _cross("C", "im")
        pairs |= _cross("KF", start) | _cross("B", start + ":") | {"T:", "d,", "d)", "d:", "d=", "dN", "[:", ":]", "::", ":,", ":)", ":=", ")H", ":H", "l:", "@i", "@(", "=r", "(r", ",N", ";N", "H+", "^$", "^N", "N$", "-$", "AF", "AD", "AK"} | _cross("l", "idm")
        pairs |= _cross("^N+-;:", first) | _cross("-", "B-") | _cross("N", "B-$") | _cross(end, "A") | _cross(",", ")]}:=") | _cross("([{", ")]}") | _cross(end + "@", "@") | _cross("@", start) | _cross("m", "bdo=.,):(N[m") | _cross("c", "N")
        pairs |= {".c"} | _cross(end, "Y") | _cross("Y", "DCA@")
        return frozenset(x for x in pairs if len(x) == 2)
    if language in ("javascript", "typescript"):
        start, end = "insc([{duwxFCpyzIm", "insc)]}pg"
        words = "DFCEKfBrykgeIXoxwc"  # words may be property names
        pairs = _cross("bd=,([{:aq;uzoxwryBNX)}k", start) | _cross(end, "bd=,;:.)]}[(Nopaq{") | _cross("N", "".join(sorted(set(start + words + end + "bd=,;:.)]}aqzuN")))) | _cross("bd=,([{:aq.;uzoxwryBkgefKDFCEIXc", "N")
        pairs |= _cross(".", "i([" + words) | _cross(words, ":,)(}].N;=") | _cross(";{}:)", words + start + ";}{N") | _cross(",([{=:aqbdu", words) | _cross("D", "i[{N") | _cross("F", "i(bN") | {"Fd", "F*"[:2]} | _cross("C", "iE{") | _cross("E", start)
        pairs |= _cross("Kf", "(") | {"fy"} | _cross("B", "{iKfcrwDyNBe(;u") | _cross("r", start + ";}N") | _cross("k", start) | _cross("g", ":i{wFCsnc[(duy") | _cross("e", ";N}i") | _cross("I", "i{sbcd(." + "g") | _cross("X", "DFC{gbi") | _cross(end, "I")
        pairs |= _cross("([{", ")]}") | _cross(",", ")]}") | _cross("s", "s") - _cross("s", "s") | {"ii"} | _cross("}", "ic") | _cross("i", "i{")
        pairs |= _cross(")", "icnsDKfrewByCFIXku") | _cross("z", start) | {"bF", "b(", "X{", "i{", "p;", "p)"} | _cross("=", "z") - _cross("=", "z") | _cross(end, "a") | _cross("q", ".:,)") | _cross("g", "iI") | _cross(":", ";") - _cross(":", ";")
        pairs |= {"K{", "[,", ",,"} | _cross("ib)]", "E")
        pairs |= _cross("^", start + words + ";N@$") | _cross(end + ";Ne", "$")
        if language == "typescript":
            pairs |= {",b", "=b"}
            pairs |= _cross("i)]}>sncbgE", "iqxCow{o") | _cross("ED", "iC") | _cross("b", ",)];=({}[Nab.:q>b>o") | _cross("cnxs", "b[=") | _cross("q", ":,)=;.") | _cross("i", "D" + "wFC@") | {"D" + "i"} | _cross(":", "xwcIFD") | _cross("@", "i") | _cross("N;{})", "@") | _cross("o", "x") | _cross("u", ":;=.)([,N") | {"iu", ")u", "]u"}
        else:
            pairs -= {"ii", "q:", "q)", "q,"}
        pairs |= {"h" + x[1] for x in pairs if x[0] == "i"} | {x[0] + "h" for x in pairs if x[1] == "i"} | _cross("h", start + "isFCchDKf*") | _cross(end, "h")
        return frozenset(pairs)
    if language == "go":
        start, end = "ins([{duFSMzr", "ins)]}pS"
        start = start.replace("r", "")
        pairs = _cross("bd=,([{:u;RrvkK", start) | _cross(end, "bd=,;:.)]}[({Npik") - _cross("ns", "i(") | _cross("N", start + "NDFKBkgrveG})];,IPR.") | _cross("bd=,([{.;rkuBPIDFKgeS", "N") | _cross(".", "i(") | {"P" + "i"} | _cross("I", "s(i.") | _cross("F", "i({") | _cross("D", "i(") | _cross("S", "{")
        pairs |= _cross("M", "[ids(M") | _cross("K", "i({;duNFsn[M") | _cross("B", "{K") | _cross("g", ":") | _cross("e", "N;i}") | {"Gi"} | _cross("i)]", "FSMid[(z") | _cross("z", "i)]d[MFS,(") | _cross("R", start) | _cross("d", "d") | _cross("r", start + "N;}") | _cross(";", start + "DKrveG{NF}") | _cross("{", "DKrvekgG;}") | _cross("}", "BKd") - _cross("}", "K") | _cross(":", "DKrveG]N}k")
        pairs |= {"^P", "^N", "NP"} | _cross("N})si;", "$")
        pairs |= _cross("([{", ")]}") | _cross(",", ")]}N") | _cross("=", "R") | _cross("d", "FM[i") | {"(D", "D)", "[z", "i:", "iR", "]s", "[:", ":]"} | _cross("v", "iF(d") | _cross(")", "i[d(MFS") | _cross("s", "N") | {"is"} | _cross("b", "F")
        return frozenset(pairs)
    if language == "rust":
        start, end = "insl([{duFKfBMrPhLe", "insl)]}p"
        pairs = _cross("bd=,([{:;uoraM", start + "LyTh$#Ff") | _cross(end, "bd=,;:.)]}[({powa") - _cross("ns", "([{") | _cross(".", "in") | _cross("F", "i(dP" ) | _cross("D", "iM(d{l[") | _cross("M", "iMld|(u[{") | _cross("T", "i{F") | _cross("L", "idub(M") | _cross("U", "ih{dD") | _cross("P", "FDTULPyi(sMf{B")
        pairs |= _cross("K", start + "D") | _cross("f", "id(M") | {"f" + "b"} | _cross("o", start) | _cross("w", "idl([MLfhuF") | _cross("B", "{K") | _cross("r", start + ";,}lb)") | _cross("e", ";,}l)") | _cross("y", "i") | _cross("h", "id{bT(UF") | _cross("ib)]>d", "hla") | _cross("#", "[u") | {"u["}
        items = "FDTLUPy#"
        pairs |= _cross(";{},)]", items + start + "#@w") | _cross("]", "i") | _cross("([{", ")]}") | _cross(",", ")]}bdp") | _cross("b", ",;)]}({[bdha=.:wa" + "fP") | _cross("d", "b,)]}{;=:lTFLd.") | _cross("i", "u@LfK") - _cross("i", "K") - {"iK"} | _cross("]", "#") | {"iu", "}B", ")B", "iB", "i$", "$i", "$(", ":l", "li", "l>", "lb", "l,", "l:", "ld", "lM", "pp", "p.", "i@"}
        pairs |= _cross("^", items + "iM;{$"[:3] + "$") | _cross("^};)]", "$") - {"]$"}
        pairs |= {";}", "n{", ";]", "b}"} | _cross("ins)]}lp", "K") | _cross("@", start) | _cross("a", start + items + "bF") | _cross("u", "{([;,=") | _cross("}", "iKfBnsl(d#.:;=p" + items) | _cross(")", "aw") | _cross("s", "s") - _cross("s", "s") | _cross("i", "fw") | _cross("bdi", "w") | _cross("w", "i") | _cross("M", "FL") | _cross(".", "t") | _cross("T", "M") | {"iM"} - {"iM"} | _cross("$", ":") | _cross(":", "i$") | _cross("nl", ":") | _cross("P", "l") | _cross("s", "{") | _cross("p", "i")-_cross("p","i") | _cross("y", "i")
        return frozenset(pairs)
    start, end = "insc([{duwpyCa", "insc)]}p"
    pairs = _cross("bd=,([{:;uaqrkoB", start) | _cross(end, "bd=,;:.)]}[({poqah") - _cross("ns", "([{") | _cross(".", "iwCcb") | {"P" + "i"} | _cross("I", "im") | _cross("m", "miCyb@({") | _cross("C", "i") | _cross("E", "i@") | _cross("Kf", "(") | _cross("B", "{iKfcrwymB(ep") | _cross("r", start + ";") | _cross("e", ";i") | _cross("w", "iy")
    pairs |= _cross("y", "i[.z)>,h(b") | _cross("i]bq)", "i@") | _cross(";{})(,:", "mPICKfBrkye@}i;c" + start) | _cross("@", "iC") | _cross("i", "EmCyKfk@z") - _cross("i", "Kfk") | _cross(")", "E{imyC@;") | _cross("E", "y") | _cross("b", "(.,){;i[E=qy@b>hm") | _cross("([{", ")]}") | _cross(",", "}q") | _cross("q", ",b:.Ei") | _cross("h", "iw") | _cross("o", "im") | _cross("m", ":a") | _cross("z", "i") | _cross("d", "b") - _cross("d", "b") | _cross("k", start) | _cross("a", "{ir") | _cross("]", "iE") | _cross("c", "b") | _cross("i", "K") - _cross("i", "K")
    pairs |= _cross("c", "iy@") | _cross("w", ";),") | {";)"}
    pairs |= {"R" + x[1] for x in pairs if x[0] == "i"} | {x[0] + "R" for x in pairs if x[1] == "i"} | {"RR"}
    pairs |= _cross("^", "PImC@;R$") | _cross("};", "$")
    return frozenset(pairs)


#: Statements that no production yields, as expressions over a statement's classes; G stands for a bracketed group.
#: Of Go, Rust, Java and TypeScript a statement begins with T (top level), B (in braces), L (in braces, the last one and not ended), S (in the
#: braces of a Go struct or interface) or A (in parentheses or square brackets). In it 1, 2, 3 stand for groups in (), [], {}, 4 for a () that
#: holds declarations (P for a statement in it) and 6 for one whose lines end without comma.
BAD_STATEMENTS: dict[str, str] = {
    "python": r"^\(=,|^[nsc]=|^J(?!.*I(?:[iGdm]))|^J.*,$|^A?[KFBT][^:]*$|^A?D(?!iG?G(?:a.*)?:)|^A?D?Dm|^C(?!iG?G?:)|^T(?!:$|:[^:])|^A?F(?!.*o.*:)|^Z.*,$|^[^KBAIJm].*w|(?<!I)d$|^[^I].*d$",
    "javascript": r"\([ih]q?:|[Dv][ih]:|^\{s:|^[TBL]Di(?:,i)*$|^[TBL](?:F13|B[3iK])|^Tk|^[TBL](?:.*[^.])?T3(?![HB])|^[TBLA].*(?<![@.])i1[in]|^[TBLA].*\.i1[in]|^[TBL].*=$",
    "typescript": r"^\{s:|^[TBL]Di$|^[TBL](?:F13|B[3iK])|^Tk|^[TBL](?:.*[^.])?T3(?![HB])|^[TBLA](?!ii=)(?:.*[^b,])?ii|^[TBLA].*(?<![@.])i1[in]|^[TBLA].*\.i1[in]|^[TBLA](?:.*[^.])?F(?:i?3|[ih]:)|^[TBL].*[Dvh]2[in]|^A(?!.*[FCa:]).*[ins]3|^A.*[ns][ins]|^[TBL].*=$",
    "go": r"^[TBL]B|^[BL]F[14][i.d]*3$|^T(?!$|Pi$|I(?:[146]|[i.]?s)$|F[14]?i2?[14][i.dMSF1234]*$|D)|^T?F.*i[iF]|^[BLA](?![DF])(?!.*F).*(?:ii|i2i)|^[TBL].*[=bud.]$|^[TBLSA](?:.*[^.])?F(?:i?3|$)|^[TBL](?![DF])(?!.*F).*4|^A(?!.*F).*[i2.]4|^[TBLA].*6|^[TBL]Di[^=]*ii|^[TBL]D[^=SF]*3|^A.*(?:[in1s]s|[ns]i)|^P.*iii",
    "rust": r"^[TBL]B|^[TBL].*F[^3a]*1a3|^[TBLA](?:.*[^.h])?F(?![1$]|i[1d$])|^[TBL].*(?:[insp]|[^P]1|[^#u]2)D|^[TBL](?:#u?2)*P*L[^3]*$|^[TBL]K[^3]*$|^[TBL].*=K[^3]*$|^[TBL].*=$|^[TBLA].*[^P$]1[in]|^[TBL](?:.*3)?DM?1i|^[TBL]DM?i:[^=ML]*bi|^[TBL]DM?[^=3]*=[^3]*3(?:B[^3]*3)*[iDfKr#FTLPU]",
    "java": r"^[TBLA][BH]|^[TBL](?:.*[^.])?T3(?![HB])|^P[^;]*;[^;=]*b[^;=]*$|^[TBLA][^k]*i1[iyscnrKfewm]|^[TBL][^k]*iii|^[TBLA][^ok]*[=r][^3oak]*(?:[insc2][iyscnrKfemw]|i4)|^[TBL].*ip[iyscnKfrem]|^[TBL](?:.*[^.])?e(?!i?$)|^[TBL].*(?:\.|w)i4(?!a)|^A.*4(?!a)|^[TBL]i4$|^[TBL]m*C[^3]*$|^[TBLA](?:.*[^.])?C(?!i)|^TI(?!m?i(?:\.[ib])*$)|^L.*[=re]|^L.*\.i1$|^[TBLA].*=w[i.b,2]*1[iyscnrKfemwC]|^P.*(?:iy|iii|yii|2ii)",
    "toml": r"^(?!(?:G|[isnv](?:\.[isnv])*=[snvG])$)",
    "json": r"^(?!(?:\{\}|\{s:[snv](?:,s:[snv])?\}|\[\]|\[[snv](?:,[snv])?\]|[snv])$)",
}
