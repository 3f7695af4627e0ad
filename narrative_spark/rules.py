"""Rule packs as data. Patterns are in Java's dialect."""

from __future__ import annotations

#: White space of all scripts: for trimming, and as a part of a character class. Java's ``\\s`` is ASCII alone, and its
#: Unicode mode is slow.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Headings.
NUMERALS = "0-9０-９一二三四五六七八九十百千万零两"
UNITS = "章节回篇卷集幕"
TITLE_LENGTH = 40
HEADING_LINE = 50
SPECIAL_TITLES = ("序章", "序言", "引子", "楔子", "前言", "后记", "尾声", "终章", "番外", "外传", "附录", "设定")
SPECIAL_SUFFIX = 6
FALSE_FRIENDS = ("最后", "下一", "上一", "这一", "第一时")
TITLE_PUNCTUATION = "[。！？；!?;]"
NUMBERED_HEADING = rf"^第[{SPACE}]*[{NUMERALS}]+[{SPACE}]*[{UNITS}](?:[ \t　]*[:：、.．·]?[ \t　]*)(.{{0,{TITLE_LENGTH}}})$"
SPECIAL_HEADING = rf"^(?:{'|'.join(SPECIAL_TITLES)})(?![{UNITS}])[ \t　]*[:：、.．·]?[ \t　]*(.{{0,{TITLE_LENGTH}}})$"
SEPARATOR_LINE = r"^[\-—–_=]{4,}$"
SEPARATOR_TITLE_LENGTH = 24
HEADING_PREFACE = 200
SEPARATOR_PREFACE = 120
PREFACE_TITLE = "（卷首）"
FALLBACK_LENGTH = 3000
CHAPTER_LENGTH = 6000
SENTENCE_ENDS = "。！？!?…”』」\n"

# Lines that a site adds to a text.
AD_PATTERNS = (
    "记住本站|本站域名|请记住|收藏本站|笔趣阁|顶点小说|全本小说|无弹窗",
    "txt下载|电子书下载|免费阅读|全本阅读|最新章节|章节目录|全文阅读|在线阅读",
    "未完待续",
    "^[ \\t　]*(?:加入|添加|收藏)?书签",
    "^[ \\t　]*手机(?:用户|版|阅读|访问|请)",
    "^[ \\t　]*(?:上一章|下一章|返回目录|点击下一页|翻页|本章完)[ \\t　]*$",
    "^[ \\t　]*(?:求|投|要|砸)\\s*月票",
    "^[ \\t　]*月票[ \\t　]*$",
    "^[ \\t　]*(?:求|投)\\s*推荐票",
    "^[ \\t　]*推荐票[ \\t　]*$",
    "^[ \\t　]*求[ \\t　]*(?:收藏|订阅|追更|打赏|点赞)[ \\t　]*$",
    "^[ \\t　]*(?:订阅|追更|打赏)[ \\t　]*(?:一下|下|吧|呗)?[ \\t　]*$",
    "^[ \\t　]*[（(【\\[]\\s*(?:本章完|未完待续|全文完|求月票|求推荐票)\\s*[)）】\\]][ \\t　]*$",
)
URL_LINE = "(?i)^[ \\t　]*(?:https?://|www\\.)\\S+[ \\t　]*$"

# Kinship and copula words, marks of one person under two names.
KINSHIP = (
    "大兒子", "小兒子", "兒子", "大女儿", "小女儿", "女兒", "父親", "母亲", "母親",
    "哥哥", "弟弟", "姐姐", "妹妹", "兄長", "丈夫", "妻子", "娘子", "岳父", "岳母",
    "女婿", "媳婦", "祖父", "祖母", "爺爺", "奶奶", "外祖", "叔父", "伯父", "舅舅",
)
COPULAS = ("叫做", "叫作", "名叫", "名喚", "名唤", "喚做", "唤做", "表字", "乃是", "就是", "即是", "便是", "名", "字")
CLAUSE_END = "[\\n。！？；]"
STRONG_MARKERS = (
    "不是別人，正是", "不是别人，正是", "不是別人正是", "不是别人正是",
    "並非別人，而是", "并非别人，而是",
    "即是", "即為", "即为", "即係", "即系",
    "賤字", "贱字", "小名", "乳名", "化名", "本名", "原名", "本姓",
)
WEAK_MARKERS = (
    "就是", "便是", "乃是", "原來是", "原来是", "本是", "本是同一人", "即是同一人",
    "自稱", "自称", "名喚", "名唤", "叫做", "叫作", "名叫", "别名", "筆名", "笔名",
)
NAME_CHARACTER = r"[^\s。！？；：，、,.!?;:“”‘’（）()《》〈〉「」『』【】\[\]]"
MARK_BETWEEN = r"[\s，,、。；;：:！!？?…“”‘’（）()《》〈〉「」『』【】\[\]]*"
WEAK_BETWEEN = r"[其本原這这那也即便正乃為为是\s，,、]*"
NAME_LENGTHS = (2, 8)
NOT_NAME_STARTS = "这這那哪个些位双隻只条张张把个件次点儿里中上下后前他她它你我谁什怎是的不和与在有为"
NOT_NAMES = (
    "他", "她", "它", "祂", "你", "我", "誰", "谁", "別人", "别人", "自己", "大家",
    "眾人", "众人", "男人", "女人", "那人", "這人", "这人", "個瘋子", "个疯子",
    "瘋子", "疯子", "這樣", "这样", "那樣", "那样", "什麼", "什么",
)
NOT_AFTER_NAME = "這这那雙双個个些"
MOST_PAIRS = 200

# Script variants, as two strings of equal length.
TRADITIONAL = "學趙約兒個這說會來時過還開紅溫習媽門問聽見對錢風雲書銀東馬萬與為無語誰認識記讓請謝點燈燭劍龍鳳寶將軍"
SIMPLIFIED = "学赵约儿个这说会来时过还开红温习妈门问听见对钱风云书银东马万与为无语谁认识记让请谢点灯烛剑龙凤宝将军"

# Persona fields, their length ranges, and stock phrases.
FIELDS = ("personality", "desire", "flaw", "secret", "speech_style")
FIELD_LABELS = {"personality": "性格", "desire": "欲望", "flaw": "缺陷", "secret": "秘密", "speech_style": "说话风格"}
FIELD_LENGTHS = {"personality": (15, 40), "desire": (10, 25), "flaw": (10, 25), "secret": (10, 30), "speech_style": (10, 25)}
CLICHES = (
    "性格复杂", "内心矛盾", "很有魅力", "多面性", "多面的", "复杂多面", "深不可测", "神秘莫测",
    "独一无二", "与众不同", "有着复杂的内心", "既有温柔的一面也有冷漠的一面",
)
IGNORED_IN_QUOTES = r"[\s，。、；：？！“”‘’（）《》〈〉「」『』…—·,.;:?!\"'()\[\]<>~-]+"
SUMMARY_FIELD = "- %s：%s"
SUMMARY_RELATION = "- 与「%s」：%s"
SUMMARY_OMITTED = "- （另有 %d 条较早的关系变化已省略）"
SUMMARY_CHANGE = "- 变化（%s）：%s → %s"
SUMMARY_EMPTY = "（无，这是首次抽取）"
CONFLICT_REASON = "第 %d 章的表述与已有画像不同，按 §7 保留较晚的并记录演化"
LENGTH_ITEM = "%s: %d 字（要求 %d–%d）"
EVIDENCE_FORCED, EVIDENCE_HINTS = "【强证据】（原文直接陈述身份，必须合并）", "【待核实】（弱标记，可能只是修辞，请结合上下文判断）"
BOOK_ID_TRIM = "《》〈〉「」『』【】[]()（）\"'“”‘’ 　._-—·"
BOOK_ID_LENGTH = 60
CONTEXT_MARKS = ("①", "②", "③")

#: For the Latin test tables: junk lines, and stock phrases.
LATIN_JUNK = (r"(?i)^\s*(https?://|www\.)\S+\s*$", r"(?i)licen[sc]e", r"^\s*[^A-Za-z0-9]+\s*$")
