"""Language profiles: word lists, patterns and thresholds that the operators take as parameters.

STANDARDS is the default, for Chinese technical standards.  PROSE is a stand-in for invented prose without
clauses, numbers or modal verbs: it gives the same operators something to find in such text.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StructureProfile:
    """How headings, clauses, tables and formulas look, and the limits of the chunker.

    The numeric defaults are fixed values.
    """

    appendix_start: str
    table_head: str
    formula_head: str
    chapter_article: str
    clause_article: str
    clause_4: str
    clause_3: str
    clause_appendix: str
    section: str
    chapter: str
    heading_char: str
    mandatory: str
    table_label: str
    formula_label: str
    article_label: tuple[str, str]
    size_chapter: float = 14.0
    size_section: float = 12.5
    size_appendix: float = 14.0
    short_line: int = 30
    chapter_length: tuple[int, int] = (4, 25)
    heading_chars: int = 2
    max_chunk: int = 800
    min_chunk: int = 50
    min_text: int = 3
    head: int = 80
    few_chunks: int = 10


# fixed values: headings of Chinese technical standards
STANDARDS = StructureProfile(
    appendix_start=r"(?U)^\s*附\s*录\s*[A-ZＡ-Ｚ\d一二三四五六七八九十]",
    table_head=r"(?U)^\s*表\s*(\d+(?:\.\d+)+)",
    formula_head=r"(?U)^\s*式\s*[\(（]?\s*(\d+(?:\.\d+)+)",
    chapter_article=r"(?U)^\s*第\s*([一二三四五六七八九十百千零〇0-9]{1,3})\s*章",
    clause_article=r"(?U)^\s*第\s*([一二三四五六七八九十百千零〇0-9]{1,6})\s*条(?!例)",
    clause_4=r"(?U)^\s*(\d{1,2}\.\d{1,2}\.\d{1,3}\.\d{1,3})(?!\d)",
    clause_3=r"(?U)^\s*(\d{1,2}\.\d{1,2}\.\d{1,3})(?!\d)",
    clause_appendix=r"(?U)^\s*([A-Z]\.\d{1,2}(?:\.\d{1,3}){1,2})(?!\d)",
    section=r"(?U)^\s*(\d{1,2}\.\d{1,2})\s+\S",
    chapter=r"(?U)^\s*(\d{1,2})\s+\S",
    heading_char=r"[\x{4e00}-\x{9fff}]",
    mandatory=r"(应|不应|严禁|必须|不得)",
    table_label="表",
    formula_label="式",
    article_label=("第", "条"),
)

PROSE = StructureProfile(
    appendix_start=r"^\S+ \S+\.$",
    table_head=r"^(\S+) \|",
    formula_head=r"^[^0-9]*([0-9]+)",
    chapter_article=r"^\S+\.$",
    clause_article=r"^(\S+) ",
    clause_4=r"^(\S+ \S+ \S+ \S+),",
    clause_3=r"^(\S+ \S+ \S+),",
    clause_appendix=r"^(\S+ \S+),",
    section=r"^(\S+ \S+ \S+)\.",
    chapter=r"^\S+",
    heading_char=r"\p{L}",
    mandatory=r"(^|[^\p{L}])(is|are|was|be)([^\p{L}]|$)",
    table_label="T:",
    formula_label="F:",
    article_label=("<", ">"),
)


@dataclass(frozen=True)
class ModalProfile:
    """Words of obligation, their tiers, and characters that make a match false."""

    pattern: str
    tiers: dict[str, str]
    direction_chars: str = ""
    guard_prev: dict[str, str] = field(default_factory=dict)
    guard_next: dict[str, str] = field(default_factory=dict)


# fixed values: words of obligation, longest first
STANDARD_MODALS = ModalProfile(
    pattern="严禁|必须|不应|不宜|不得|不可|应|宜|可",
    tiers={
        "必须": "must", "严禁": "must", "不应": "must", "不得": "must", "应": "must",
        "不宜": "should", "宜": "should", "不可": "may",
    },
    direction_chars="大小高低多少长短",
    guard_prev={"应": "响供适反顺答呼相感效理", "宜": "适便事"},
    guard_next={"应": "用该当对答付急届变邀有力", "宜": "人居"},
)

PROSE_MODALS = ModalProfile(
    pattern=r"(?<![\p{L}\p{N}])(?:are|was|for|with|is|be)(?![\p{L}\p{N}])",
    tiers={"is": "must", "are": "must", "was": "should", "be": "should", "for": "may", "with": "may"},
)

# fixed values: number with an optional unit, and the words before a number that set its direction
NUMBER_PATTERN = r"\d+(?:\.\d+)?\s*(?:m[²³]?|cm|mm|km|hm[²³]?|%|°|度|人|套|班|户|床|kg|t|级)?"
NUMBER_DIRECTION_CHARS = "大小高低多少长短等"
KEY_NUMBER_PATTERN = (
    r"\d+(?:\.\d+)?\s*(?:m²|m³|m|km|%|kV|MPa|kN|度|年|人|床|班|辆|座|个|处|级|min|s|h|t)"
)
PROSE_NUMBER_PATTERN = r"[0-9]+(?:[.-][0-9]+)*"

# fixed values: formula signal of a citation
FORMULA_SIGNAL = r"按下式计算|按下列公式计算|应按下式|式\s*[（(]\s*\d+\.\d+"

# fixed values: dictionary of known misreadings, applied in this order
REPAIRS = {
    "坏境": "环境", "贼市": "城市", "改著": "改善", "政计": "设计", "店任": "居住", "保沪": "保护",
    "宜案用": "宜采用", "游患": "游憩", "完著": "完善", "路同密度": "路网密度", "不应低丁": "不应低于",
    "8.0m7人": "8.0m²/人", "灭于": "大于", "室间": "空间", "轴助": "辅助", "堆护": "维护", "观定": "规定",
    "其备": "具备", "工其": "工具", "人库": "入库", "其体": "具体", "安金": "安全", "城币": "城市",
    "了列": "下列", "数括": "数据", "系疏": "系统", "指施": "措施", "规刘": "规划",
}
UNIT_PATTERN = r"(\d(?:[\d.]*\d)?\s*)m(?:r)?(\s*/\s*(?:人次|人|床|生))"
UNIT_HEADER_PATTERN = r"([（(《\[【])m(?:r)?(\s*/\s*(?:人次|人|床|生))"
UNIT_REPLACEMENT = "$1m²$2"

# fixed values: page furniture, whole lines only
FURNITURE = [
    "住房城乡建设部信息公开", "浏览专用", "住房城乡建设部信息公", "住房城乡建设部", "信息公开", "住房城乡建",
    "住房城乡建浏览专用", "住房城乡建设浏览专用", "住房城乡建设部信", "住房城乡建设部信息", "住房城乡建设",
    "住房城乡建设部信息公升", "部信息公开", "设部信息公开", "住房城乡建设部信隐", "住房城乡建设部停",
    "住房城乡建谈浏览专用", "住房城乡建设部信愿", "郄信息公开", "住房城乡建德", "住房城乡建设部倍",
    "住房城乡建设部信A", "住房城乡建馈部信息公开",
]
FURNITURE_KEYWORDS = ["住房城乡建", "信息公开", "浏览专用"]
PAGE_NUMBER = r"^\d{1,4}$"

# fixed values: first issue scan
SCAN_ERRORS = {
    "贼市": "城市", "改著": "改善", "坏境": "环境", "政计": "设计", "定牌": "（待人工确认）", "白勺": "的", "扦": "并",
}
PUNCTUATION_RUN = r"([。，；：、，,;:])\1{2,}"
ZERO_MIXUP = r"\d[〇○]"
ONE_MIXUP = r"(?<![a-zA-Z])[lI](?=\d*(?:cm|mm|km|hm|m[²³]?\b|度|°))"
LATIN_IN_CJK = r"[一-鿿]{2,}[a-zA-Z]{3,}[一-鿿]{2,}"
USUAL_CHARS = (
    r"[\x{00}-\x{7f}\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}\x{2010}-\x{2030}\x{0391}-\x{03c9}"
    r"·°¥™©®§¶∠×÷±√≤≥≠≈∞∑∏∫∂]"
)

# fixed values: second issue scan
SCAN_2_ERRORS = {
    "贼市": "城市", "改著": "改善", "坏境": "环境", "政计": "设计", "保沪": "保护", "游患": "游憩",
    "不应低丁": "不应低于", "路同密度": "路网密度", "宜案用": "宜采用", "完著": "完善", "数他": "设施",
    "店任": "居住", "8.0m7人": "8.0m²/人",
}
UNIT_DROPS = [
    (r"(\d+\.?\d*)\s*m\s*/\s*人", "$1m²/人"),
    (r"(\d+\.?\d*)\s*m\s*/\s*床", "$1m²/床"),
    (r"(\d+\.?\d*)\s*m\s*/\s*生", "$1m²/生"),
    (r"(\d+\.?\d*)\s*m\s*/\s*张", "$1m²/张"),
    (r"每\s*(\d+)\s*m\s*(绿地|座位|标台|个|户)", "每$1m²$2"),
]
NUMBER_LETTER = r"\d+(\.\d+)?\s*m\s*\d"
SUSPICIOUS = {"丁": "于", "灭": "大", "卷": "者", "胃": "置"}
SUSPICIOUS_CONTEXTS = ["低{}", "灭{}", "{}于", "{}市"]

# fixed values: triage
SENSITIVE = [
    r"如何.{0,8}规避", r"怎么.{0,8}规避", r"如何.{0,8}绕过", r"怎么.{0,8}绕过", r"不被.{0,8}审查", r"不被.{0,8}发现",
    r"绕(过|开).{0,5}(审|检|查)", r"违规.{0,4}(怎么|如何)", r"偷偷.{0,15}(做|建|盖|搞|算|报|拿|放|做)", r"偷.{0,3}做",
    r"藏.{0,3}起来", r"瞒.{0,3}过", r"假报.{0,3}", r"虚报.{0,3}", r"少算.{0,3}", r"怎么.{0,20}过审", r"如何.{0,20}过审",
    r"怎么.{0,20}过(检|查)", r"顺利.{0,8}过(审|检|关)",
]
DEPRECATED_CODE = r"(?i)(?:GB|JGJ|CJJ|GBJ|TB)[\s/]?\d+\s*[-–—]\s*(?:1993|1987|1999|2002|2006|93|87|99)(?!\d)"
DEPRECATED = [
    ("GB 50180-93", "GB 50180-2018", "城市居住区规划设计标准", "2018"),
    ("GB 50180-2002", "GB 50180-2018", "城市居住区规划设计标准", "2018"),
    ("GB 50016-2006", "GB 50016-2014 / GB 55037-2022", "建筑设计防火规范 / 建筑防火通用规范", "2014 / 2022"),
    ("GB 50096-1999", "GB 50096-2011 / GB 55037-2022", "住宅设计规范 / 建筑防火通用规范", "2011 / 2022"),
    ("JGJ 39-87", "JGJ 39-2016", "托儿所、幼儿园建筑设计规范", "2016"),
    ("GBJ 16-87", "GB 50016-2014 / GB 55037-2022", "建筑设计防火规范 / 建筑防火通用规范", "2014 / 2022"),
]
TAIL = r"[\s\?！？!~。.啊呀哈呢吧呦哟嘛]*"
CHITCHAT = [
    rf"^(你好|您好|hi|hello|嗨|早上好|晚上好|下午好){TAIL}$",
    rf"^(谢谢|多谢|感谢|thx|thanks?){TAIL}$",
    rf"^(再见|拜拜|bye|goodbye){TAIL}$",
    rf"^(你是谁|你是什么|介绍.{{0,5}}自己|你能.{{0,3}}什么){TAIL}$",
    r"^(这|这个|该|本)(系统|工具|助手|程序|AI|平台).{0,10}(是|能|做|帮|查|干).{0,5}\??$",
    rf"^(测试|test|123|hello world){TAIL}$",
]
OUT_OF_SCOPE = [
    "推荐一下", "好不好", "好吃", "python", "代码", "怎么写", "bug", "报错", "新闻", "股票", "天气", "翻译",
    "做菜", "做饭", "电影", "游戏", "电视剧",
]
QUESTION_WORDS = [
    "?", "？", "几", "多少", "什么", "怎么", "如何", "哪", "是否", "能否", "是不是", "需要", "可以", "应该",
    "要求", "标准", "规定",
]
CONCRETE_WORDS = [
    "居住区", "住宅", "幼儿园", "学校", "医院", "建筑", "楼", "厂房", "道路", "绿地", "公园", "广场", "停车", "幼托",
    "服务半径", "耐火", "防火", "高度", "宽度", "面积", "层数", "间距", "密度", "容积率", "绿地率", "退距", "退线",
    "GB", "JGJ", "CJJ",
]


@dataclass(frozen=True)
class TriageProfile:
    """Patterns, word lists and length limits of the scenario rules."""

    sensitive: str
    chitchat: str
    out_of_scope: list[str]
    question_words: list[str]
    concrete_words: list[str]
    deprecated_code: str
    deprecated: list[tuple[str, str, str, str]]
    max_length: int = 4000
    scope_length: int = 30
    very_short: int = 4
    mid_length: int = 15


STANDARD_TRIAGE = TriageProfile(
    sensitive="(?i)" + "|".join(SENSITIVE),
    chitchat="(?i)" + "|".join(CHITCHAT),
    out_of_scope=OUT_OF_SCOPE,
    question_words=QUESTION_WORDS,
    concrete_words=CONCRETE_WORDS,
    deprecated_code=DEPRECATED_CODE,
    deprecated=DEPRECATED,
)

PROSE_TRIAGE = TriageProfile(
    sensitive="(?i) (edeaux|une|einheit|ndr[a-z]*|hand) ",
    chitchat="(?i)^(in|la|is|der|and)[^.]{0,40}[.]$",
    out_of_scope=["ouè", "schau", "thre"],
    question_words=[" the ", " la ", " die ", " que "],
    concrete_words=["tion", "ment", "ung", "keit", "ing", "ent", "ción"],
    deprecated_code=r"(?i)[a-z]*st (?:in|of|der|die|ach)",
    deprecated=[("enst in", "enst of", "first", "2018"), ("st der", "st die", "second", "2014"),
                ("whst of", "whst in", "third", "2022"), ("st die", "st der", "fourth", "2020")],
    max_length=350, scope_length=120, very_short=40, mid_length=120,
)


@dataclass(frozen=True)
class RouteProfile:
    """Signals of the routing rules."""

    code: str
    clause: str
    catalog: str
    status: str
    clause_lookup: str
    broad: str
    compound: str
    specific: str


# fixed values: routing signals
STANDARD_ROUTES = RouteProfile(
    code=(
        r"(?i)(GB\s*/?\s*T?\s*\d{4,5}|JGJ\s*/?\s*T?\s*\d{2,3}|CJJ\s*/?\s*T?\s*\d{2,3}"
        r"|DB\s*\d{2}|WW\s*/?\s*T?\s*\d{4}|建标\s*\[?\d{4})"
    ),
    clause=r"(第\s*)?\d+\.\d+(\.\d+)?\s*条?|表\s*\d+\.\d+",
    catalog=(
        r"(收录|规范库|库里|你有).{0,8}(哪些|什么|多少)|哪些.{0,6}规范(有|吗|\?|？|$)"
        r"|规范.{0,4}(清单|列表|目录)"
    ),
    status=(
        r"(还|是否|是不是).{0,4}(有效|现行|在用)|(作废|废止|失效|过期).{0,3}(了吗|吗|没有|\?|？)"
        r"|现行(有效)?吗|最新版本(是|吗)"
    ),
    clause_lookup=r"原文|条文内容|这条.{0,4}(说|写|规定)什么|怎么写的",
    broad=(
        r"(有什么|有哪些|哪些).{0,6}(要求|规定|标准|规范|注意)"
        r"|需要注意(什么|哪些)|注意事项|(要求|规定).{0,3}(有哪些|是什么)"
    ),
    compound=(
        r"[^，。？?]{2,20}(和|与|及|以及|、)[^，。？?]{2,20}"
        r"(的)?\s*(要求|规定|标准|指标|因素|区别|差异)"
    ),
    specific=(
        r"半径|粒径|宽度|高度|面积|比例|密度|坡度|厚度|间距|净宽|净高|极限|烈度"
        r"|稳定性|层数|规模|数量|下限|上限|最低|最小|最大|覆盖率|多少"
    ),
)

PROSE_ROUTES = RouteProfile(
    code=r"(?i)(heed|eaux|schaft|ción|ening)",
    clause=r"(?i)(onth|ement|lich|cion)",
    catalog=r"(?i)(^the |^la |^die |^el )",
    status=r"(?i)( with | avec | mit | con )",
    clause_lookup=r"(?i)( from | pour | von | por )",
    broad=r"(?i)( and | et | und | y )",
    compound=r"(?i)([a-z]{4,} and [a-z]{4,}|[a-z]{4,} et [a-z]{4,}|[a-z]{4,} und [a-z]{4,})",
    specific=r"(?i)( for | sur | auf | para )",
)

# stand-ins for prose
PROSE_REPAIRS = {"thth": "th", "eaux": "eau", "schsch": "sch", "eau eau": "eau", "ciónció": "ción", "ingin": "inging"}
PROSE_UNIT = r"([a-z])tion([ .,])"
PROSE_UNIT_REPLACEMENT = "$1sion$2"
PROSE_FURNITURE = [
    "The and attion to thanedble the, anea. Eriner thanea.", "En laleenéelle la des et. Enmentai. Réleou eauoué.",
    "Nicht aulich für sch erüver enau sch der.", "Erreth was ofretihaou the that edouhe.", "And ornd.",
    "And therhean is the is esndha reedes ha.", "In in oredble ea.",
]
PROSE_FURNITURE_KEYWORDS = ["Licensed", "reserved", "thanedble", "And "]
PROSE_PAGE_NUMBER = r"^\S{1,12}$"
PROSE_ERRORS = {"thth": "th", "eaux": "eau", "schsch": "sch", "Licensed": "licensed"}
PROSE_PUNCTUATION_RUN = r"\.{3,}|,{3,}|\*{3,}|%{3,}|#{3,}|!{3,}|\${3,}"
PROSE_ZERO_MIXUP = r"[0-9][oO]"
PROSE_ONE_MIXUP = r"[lI][0-9]"
PROSE_MIXED_RUN = r"[a-z]{2,}[éèêçñóüöäß]{2,}[a-z]{2,}"
PROSE_USUAL = r"[\x{00}-\x{7f}éèêçñóíüöäßÉÈÇÜÖÄ]"
PROSE_UNIT_DROPS = [(r"([a-z]+)sh the", "$1sh of the"), (r"der ([a-z]+) die", "der $1, die")]
PROSE_NUMBER_LETTER = r"[a-z]+\$+[a-z]|[0-9]+-[0-9]"
PROSE_SUSPICIOUS = {"ndnd": "nd", "ê": "é"}
PROSE_SUSPICIOUS_CONTEXTS = ["{}re", "ou{}", "{}th"]

# fixed values: second-level groups of the standards, by code
SUBCATEGORIES = {
    "GB 50180-2018": "居住社区", "GB/T 47131.1-2026": "居住社区",
    "CJJ/T 87-2020": "公共设施", "GB 50437-2007": "公共设施", "GB 50442-2008": "公共设施",
    "GB 50442 - 20XX": "公共设施", "GB 55028-2022": "公共设施",
    "CJJ/T 314-2022": "交通市政", "DB 31T 1557-2025": "交通市政", "GB 50318-2017": "交通市政",
    "GB/T 50546-2018": "交通市政", "GB/T 51328-2018": "交通市政", "GB/T 51402-2021": "交通市政",
    "GB/T 51439-2021": "交通市政",
    "GB 51287-2018": "绿地生态", "GB 51411-2020": "绿地生态", "GB/T 51329-2018": "绿地生态",
    "GB/T 51346-2019": "绿地生态",
    "GB/T 50298-2018": "历史风景", "GB/T 50357-2018": "历史风景",
    "历史文化名城名镇名村保护条例(2017修正)": "历史风景",
    "GB/T 51327-2018": "防灾地下", "GB/T 51358-2019": "防灾地下", "建标[2012]192号": "防灾地下",
    "CJ/T 553-2024": "数据术语", "CJJ/T 199-2013": "数据术语", "GB/T 39972-2021": "数据术语",
    "GB/T 43214-2023": "数据术语", "JGJ/T 30-2015": "数据术语",
    "CJJ 193-2012": "道路工程", "CJJ 194-2013": "道路工程", "CJJ 221-2015": "道路工程", "CJJ 36-2016": "道路工程",
    "GB 55011-2021": "道路工程",
    "CJJ 45-2015": "城市照明", "CJJ/T 307-2019": "城市照明",
    "GB 51222-2017": "给水排水", "GB/T 51293-2018": "给水排水",
    "GB 50838-2015": "综合管廊", "GB 51354-2019": "综合管廊",
    "GB/T 50293-2014": "能源供热", "GB/T 51074-2015": "能源供热", "GB/T 51357-2019": "能源供热",
    "CJJ 52-2014": "环卫与其他", "CJJ/T 100-2017": "环卫与其他", "CJJ/T 149-2021": "环卫与其他",
    "建标函[2004]43号": "环卫与其他",
    "GB 50368-2005": "居住建筑", "JGJ 286-2013": "居住建筑", "GB/T 21741-2021": "居住建筑",
    "JGJ 39-2016": "教育建筑", "JGJ 76－2019": "教育建筑", "JGJ/T 280-2012": "教育建筑",
    "城市普通中小学校校舍建设标准": "教育建筑", "建标 109-2008": "教育建筑", "建标 192-2018号": "教育建筑",
    "GB 51039-2014": "医疗养老", "GB 50867-2013": "医疗养老",
    "JGJ/T 41-2014": "文化体育", "公共美术馆建设标准": "文化体育", "GB/T 50948-2013": "文化体育",
    "GB 50033-2013": "光环境", "GB/T 50034-2024": "光环境",
    "GB 55031-2022": "通用与无障碍", "GB 50763-2012": "通用与无障碍", "CJJ 14-2016": "通用与无障碍",
    "JGJ/T 245-2024": "通用与无障碍",
    "CJJ/T 75-2023": "绿地设计", "DB 5301:T 21-2019": "绿地设计", "CJJ/T 308-2021": "绿地设计",
    "CJ/T 24-2018": "种植养护", "CJJ/T 287-2018": "种植养护", "CJJ/T 292-2018": "种植养护",
    "GB/T 51168-2016": "种植养护",
    "GB 55014-2021": "工程与管控", "GB/T 51163-2016": "工程与管控",
    "CJJ/T 171-2012": "标志与术语", "CJJ/T 91-2017": "标志与术语", "CJJ/T 237-2016": "标志与术语",
}
SUBCATEGORY_ORDER = {
    "规划": ["居住社区", "公共设施", "交通市政", "绿地生态", "历史风景", "防灾地下", "数据术语"],
    "市政": ["道路工程", "城市照明", "给水排水", "综合管廊", "能源供热", "环卫与其他"],
    "建筑": ["居住建筑", "教育建筑", "医疗养老", "文化体育", "光环境", "通用与无障碍"],
    "景观": ["绿地设计", "种植养护", "工程与管控", "标志与术语"],
}
UNCLASSIFIED = "未分类"
SUBDIVIDE_MIN = 8

# fixed values: domain of a source file by the longest matching name prefix
DOMAIN_PREFIXES = {
    "CJJ:T199-2013": "规划", "CJJ:T314-2022": "规划", "DB31T+1557-2025": "规划", "GB 50180-2018": "规划",
    "GB50180-2018": "规划", "GB50318-2017": "规划", "GB50437-2007": "规划", "GB50442": "规划", "GB:T50298-2018": "规划",
    "GB:T50357-2018": "规划", "GB:T50546-2018": "规划", "GB:T51327-2018": "规划", "GB:T51328-2018": "规划",
    "GB:T51346-2019": "规划", "GB:T51402-2021": "规划", "GB:T51439-2021": "规划", "GBT+39972-2021": "规划",
    "GBT+43214-2023": "规划", "GBT+47131.1-2026": "规划", "上海市": "规划", "CJ:T553-2024": "规划", "CJJ:T87—2020": "规划",
    "GB 55028-2022": "规划", "GB50442-2008": "规划", "GB:T51329-2018": "规划", "GB:T51358—2019": "规划", "建标[2012]192号": "规划",
    "JGJ:T30-2015": "规划", "GB51287-2018": "规划", "GB51411—2020": "规划", "《历史文化名城名镇名村保护条例》(2017年修正_可搜索.pdf": "规划",
    "GB 50368-2005": "建筑", "GB 55031-2022": "建筑", "GB50033-2013": "建筑", "GB50867-2013": "建筑", "GB51039-2014": "建筑",
    "GB:T50034-2024": "建筑", "GBT+21741-2021": "建筑", "JGJ39-2016《托儿所、幼儿园建筑设计规范》(2019年版)": "建筑", "JGJ76": "建筑",
    "JGJ286-2013": "建筑", "JGJ:T245-2024": "建筑", "建标 109": "建筑", "建标192": "建筑", "建标 109—2008": "建筑",
    "CJJ14-2016": "建筑", "GB50763-2012": "建筑", "GB:T50948-2013": "建筑", "JGJ:T280-2012": "建筑", "JGJ:T41-2014": "建筑",
    "建标192—2018号": "建筑", "《公共美术馆建设标准》_可搜索.pdf": "建筑", "《城市普通中小学校校舍建设标准》_可搜索.pdf": "建筑",
    "CJ:T24-2018": "景观", "CJJ:T75-2023": "景观", "CJJ:T91-2017": "景观", "CJJ:T287-2018": "景观", "CJJ:T308-2021": "景观",
    "DB5301:T 21": "景观", "GB 55014-2021": "景观", "CJJ:T171-2012": "景观", "CJJ:T237-2016": "景观", "CJJ:T292-2018": "景观",
    "GB:T51163-2016": "景观", "GB:T51168-2016": "景观",
    "GB 55037-2022": "消防", "DB31T+1695-2026": "消防", "WW:T 0125": "消防", "GB 55036-2022": "消防", "GB50067-2014": "消防",
    "建标[2015]273号": "消防",
    "CJJ:T301-2020": "结构", "JGJ99-2015": "结构", "JGJ:T259-2012": "结构", "JGJ:T415-2017": "结构",
    "CJJ193-2012": "市政", "CJJ194-2013": "市政", "CJJ221-2015": "市政", "CJJ36-2016": "市政", "CJJ45-2015": "市政",
    "CJJ52-2014": "市政", "CJJ:T100-2017": "市政", "CJJ:T149-2021": "市政", "CJJ:T307-2019": "市政", "GB50838-2015": "市政",
    "GB51354-2019": "市政", "GB55011-2021": "市政", "GB:T50293-2014": "市政", "GB:T51074-2015": "市政",
    "GB:T51293-2018": "市政", "GB:T51357-2019": "市政", "建标函[2004]43号": "市政", "GB51222-2017城镇内涝防治技术规范》_可搜索.pdf": "市政",
}
EXCLUDED_FILES = ["JGJ39-2016《托儿所、幼儿园建筑设计规范》_可搜索.pdf"]
FILE_OVERRIDES = {
    "上海市“15分钟社区生活圈”行动工作导引》.pdf": ("沪规划资源（2021）", "上海市15分钟社区生活圈行动工作导引"),
    "GB51222-2017城镇内涝防治技术规范》_可搜索.pdf": ("GB 51222-2017", "城镇内涝防治技术规范"),
    "《公共美术馆建设标准》_可搜索.pdf": ("公共美术馆建设标准", "公共美术馆建设标准"),
    "《历史文化名城名镇名村保护条例》(2017年修正_可搜索.pdf": (
        "历史文化名城名镇名村保护条例(2017修正)", "历史文化名城名镇名村保护条例"),
    "《城市普通中小学校校舍建设标准》_可搜索.pdf": (
        "城市普通中小学校校舍建设标准", "城市普通中小学校校舍建设标准"),
}
IN_FORCE = "现行"
TIERS = [("国标", "GB"), ("行标", ""), ("地标", "DB")]

# stand-ins for prose: groups of brands, their order per part type
PROSE_GROUPS = {f"Brand#{i}": ["metal", "wood", "glass", "paper"][i % 4] for i in range(1, 21)}
PROSE_GROUP_ORDER = {"PROMO": ["glass", "metal", "wood"], "LARGE": ["wood", "paper", "metal", "glass"]}
PROSE_PREFIXES = {
    "http://": "web", "https://": "web", "http://m.": "mobile", "https://m.": "mobile", "https://blog.": "journal",
    "http://blog.": "journal", "https://spam": "junk", "http://spam": "junk",
}
