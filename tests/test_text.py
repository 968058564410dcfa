import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from wordloom.constants import CLEAN_STEPS, STOP_WORDS, WORD
from wordloom.functions import text

CLEANED = [
    ("홍길동 기자 hong@news.co.kr 입니다", "  입니다"),
    ("(서울=연합뉴스) 김철수 기자 = 내용", "   내용"),
    ("[앵커] 오늘 【속보】 <그림 1> 02-123-4567 1588-1234 2019-10-11 12:13:14", " 오늘      "),
    ("www.example.com 뒤 텍스트\n다음 줄", "\n다음 줄"),
    ("a.com b xcom 가나다com 나.co.kr 다.go.kr", "a.com b xcom"),
    ("(①) 漢字 테스트 ㈜삼성 “인용” 'x'", "  테스트 삼성 인용 x"),
    ("½가나 기자", ""),
    ("텍스트 www.a.b 끝", "텍스트 "),
    ("é́ 기자", "é́ 기자"),
    ("ée 기자", ""),
]


def one_column(spark, values, use):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", use(F.col("t")).alias("t"))
    return [row["t"] for row in rows.orderBy("i").collect()]


def test_clean_text_goldens(spark):
    assert one_column(spark, [raw for raw, _ in CLEANED], text.clean_text) == [clean for _, clean in CLEANED]


def test_clean_text_null(spark):
    assert one_column(spark, [None, ""], text.clean_text) == [None, ""]


@pytest.mark.parametrize("name", [name for name, _, _ in CLEAN_STEPS])
def test_each_step_equals_its_bare_pattern(spark, name):
    """The literal a step looks for first must not change what it removes."""
    texts = [raw for raw, _ in CLEANED] + ["a@", "x.co.kr yco.kr", "/credit=홍길동 @x", "a?com", "1234-56-78", "-:@</(["]
    pattern = next(p for n, _, p in CLEAN_STEPS if n == name)
    bare = one_column(spark, texts, lambda t: F.regexp_replace(t, pattern, ""))
    assert one_column(spark, texts, lambda t: text.clean_step(t, name)) == bare


def test_word_class_equals_python(spark):
    """Every assigned character of the basic plane falls in or out as Python's ``\\w`` has it."""
    characters = [
        chr(code)
        for code in range(1, 0x10000)
        if not 0xD800 <= code < 0xE000 and unicodedata.category(chr(code)) != "Cn"
    ]
    kept = one_column(spark, ["".join(characters)], lambda t: F.regexp_replace(t, f"[^{WORD}]", ""))[0]
    theirs = {c for c in characters if c == "_" or c.isalnum()}
    # Java 17 knows an older Unicode version, so it lacks the newest characters.
    assert set(kept) <= theirs
    assert len(theirs - set(kept)) < 100


def test_strip_space_equals_python(spark):
    spaces = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
    assert one_column(spark, [spaces + "a b" + spaces, "\n", ""], text.strip_space) == ["a b", "", ""]


def test_normalise_body_order(spark):
    raw = "\n// flash 오류를 우회하기 위한 함수 추가\nfunction _flash_removeCallback() {}\n 본문\n둘 "
    assert one_column(spark, [raw], text.normalise_body) == ["본문 둘"]


def test_tokenize(spark):
    assert one_column(spark, ["Apple a b2 가나 _x é", "", None], text.tokenize) == [["apple", "b2", "가나", "_x"], [], None]
    assert one_column(spark, ["A bb"], lambda t: text.tokenize(t, 1)) == [["a", "bb"]]
    with pytest.raises(ValueError):
        text.tokenize(F.col("t"), 0)


def test_halves(spark):
    assert one_column(spark, ["a b c d e", "one", "a  b "], text.text_halves) == [
        ["a b", "c d e"],
        ["", "one"],
        ["a ", "b "],
    ]


def test_dates(spark):
    raw = ["2019.10.03.", "2019-10-03", "2019.10.03 ", "none", None]
    day = datetime.date(2019, 10, 3)
    assert one_column(spark, raw, text.parse_date) == [day, day, day, None, None]
    assert one_column(spark, raw[:2], text.normalise_date) == ["20191003", "20191003"]


def test_stop_word_list():
    assert len(STOP_WORDS) == 128
    assert len(set(STOP_WORDS)) == 125
