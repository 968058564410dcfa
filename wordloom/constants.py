"""Results are only right if these stay exactly as they are.

Character classes are spelled out because the engines disagree on the shorthands:
``\\w`` is ASCII-only in Java, and its Unicode mode differs from Python's meaning.
The spelled-out forms mean the same in Java, Python ``regex`` and RE2.
"""

# Inner parts of character classes; put them inside brackets.
WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
DIGIT = r"\p{Nd}"
# Any character but a line feed; complete as it is.
ANY = r"[^\n]"

# What may stand between a pair of brackets that is removed with its content.
BRACKETED = WORD + SPACE + "‘’=/·~:&,`"

# Characters that are removed wherever they stand.
SYMBOLS = "◇#/▶▲◆■●△①②③★○◎▽=▷☞◀ⓒ□?㈜♠☎"
QUOTES = "\"'”“‘’"

# Cleaning steps in order: (name, literal a text must contain to match, pattern).
CLEAN_STEPS = [
    ("email", "@", rf"[{WORD}.]+@[{WORD}.]+"),
    ("email_head", "@", rf"[{WORD}.]+@"),
    ("angle_brackets", "<", rf"<[{BRACKETED}]+>"),
    ("round_brackets", "(", rf"\([{BRACKETED}]+\)"),
    ("square_brackets", "[", rf"\[[{BRACKETED}]+\]"),
    ("lenticular_brackets", "【", rf"【[{BRACKETED}]+】"),
    ("long_phone", "-", rf"{DIGIT}{{2,3}}-{DIGIT}{{3,4}}-{DIGIT}{{4}}"),
    ("short_phone", "-", rf"{DIGIT}{{3,4}}-{DIGIT}{{4}}"),
    ("www_to_line_end", "www", rf"www{ANY}[{WORD}]{ANY}+"),
    ("com_host", "com", rf"{ANY}[{WORD}]+{ANY}com"),
    ("co_kr_host", "kr", rf"{ANY}[{WORD}]+{ANY}co{ANY}kr"),
    ("go_kr_host", "kr", rf"{ANY}[{WORD}]+{ANY}go{ANY}kr"),
    ("credit_line", "/", rf"/[{WORD}]+[=·{WORD}@]+[{WORD}]+[{SPACE}][=·{WORD}@]+"),
    ("reporter", "기자", rf"[{WORD}]{{2,4}}[{SPACE}]기자"),
    ("han", None, r"[\x{2E80}-\x{2EFF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FBF}\x{F900}]+"),
    ("symbols", None, f"[{SYMBOLS}]"),
    ("quotes", None, f"[{QUOTES}]"),
    ("date", "-", rf"{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}}"),
    ("clock", ":", rf"{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"),
]

# Script text that the portal's pages leave inside the article body.
BODY_BOILERPLATE = (
    "// flash 오류를 우회하기 위한 함수 추가 function _flash_removeCallback() {}"
)

# Stop words, as published; repeated entries included.
STOP_WORDS = [
    "출처", "기자", "하지", "하기", "천억", "진짜", "이것", "저것", "누구", "무엇", "그것", "위해", "역시", "이런", "저런", "그런", "무슨",
    "누가", "요즘", "끼리", "가지", "정말", "보기", "하나", "이제", "어디", "라이", "아주", "바로", "자기", "그냥", "지금",
    "바로", "그냥", "다른", "이번", "해주", "언제", "때문", "완전", "이건", "보고", "얼마나", "모두", "너희", "우리", "당신", "해도",
    "해주",
    "하라", "건가", "요게", "그게", "이게", "그거", "저거", "지랄", "대가리", "이날", "오전", "관련", "동양", "입장", "오후", "당시",
    "가능",
    "과정", "경우", "생각", "진행", "이상", "시작", "가운데", "정도", "이후", "내용", "주장", "확인", "공개", "일부", "준비", "대상",
    "부분", "핵심",
    "상태", "입시", "보도", "결과", "동안", "시절", "차례", "다음", "포함", "학원", "사모", "정보", "언급", "지난", "지난달", "사이",
    "왼쪽", "처음", "상대",
    "결국", "직후", "개인", "얘기", "대신", "여기", "사실", "최근", "전날", "뉴스", "사람", "전문", "본인", "제기", "있다",
    "있다.", "무단", "배포", "니다", "월", "년", ".", "_", "-", ",",
]

# Section blocks of a ranking page, and how many anchors of each block count.
RANKING_SECTION_IDS = [
    "ranking_100", "ranking_101", "ranking_102", "ranking_103", "ranking_104", "ranking_105",
]
RANKING_DEPTH = 5

# Comments per landed response page.
COMMENT_PAGE_SIZE = 20

# Keyword graph and keyword table.
MIN_DF = 0.01
MAX_FEATURES = 1000
TOP_N = 50
TFIDF_ROWS = 100
EDGE_PERCENTILE = 0.75
EDGE_EPSILON = 1e-9
EDGE_OFFSET = 0.2
PIPELINE_THRESHOLD = 0.05
FUNCTION_THRESHOLD = 0.1
MEASURES = ["frequency", "pagerank", "betwenness", "weighted_degree", "closeness", "eigenvector"]

# Library defaults behind the weighted PageRank.
PAGERANK_ALPHA = 0.85
PAGERANK_ROUNDS = 100
PAGERANK_TOLERANCE = 1e-6
