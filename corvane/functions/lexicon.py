"""Pattern tables used by routing, scope and video rules, and the predicate that applies them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    label: str
    regex: str
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?iu)" if self.ignore_case else "") + self.regex


# Word lists that decide route, scope and video acceptance.
LEAGUE = Pattern(
    "league",
    r"ABS|자동\s*투구|피치\s*클락|체크\s*스윙|비디오\s*판독|엔트리|아시아\s*쿼터|연장|"
    r"포스트시즌|가을야구|3피트|승부치기|18인치",
    True,
)
LIVE = Pattern(
    "live",
    r"순위|승률|일정|남은\s*경기|잔여\s*경기|다음\s*경기|오늘.{0,8}경기|내일.{0,8}경기|"
    r"경기\s*결과|경기\s*시간|몇\s*시|하이라이트|선수\s*명단|로스터|엔트리\s*명단|뉴스|"
    r"누구|어떤\s*선수|소속|연봉|프로필|몇\s*살|나이|출신|연고지|본거지|홈구장|창단|우승",
)
LATEST = Pattern("latest", f"(?:{LEAGUE.regex})|(?:{LIVE.regex})", True)
RULE = Pattern(
    "rule",
    r"(?<![\d.])[1-9]\.\d{2}(?![\d.])|"
    r"규칙|룰|판정|아웃|세이프|스트라이크|볼넷|인필드|보크|용어|뜻|무엇|뭐야|어떻게\s*되|"
    r"타점|도루|번트|플라이|홈런|주루|파울|병살|낫아웃|담장|스트라이크\s*존|포스\s*아웃|"
    r"투수|타자|주자|포수|내야|외야|심판|구장|베이스|배트|글러브|유니폼|마운드|덕아웃|"
    r"이닝|타석|투구|송구|포구|득점|안타|만루|번트|누상|타순|대타|대주자|몰수|라인|"
    r"몇\s*명|인원|정원|선수\s*수|포지션|수비\s*위치|경기\s*방법|진행\s*방식|"
    r"경기의?\s*목적|룰북|규칙집|몇\s*이닝|연장전|플레이",
)
DOMAIN = Pattern(
    "domain",
    r"야구|KBO|MLB|프로야구|메이저리그|리그|구단|연고지|홈구장|선수|감독|코치|시즌|우승|한국시리즈|"
    r"트윈스|베어스|히어로즈|랜더스|위즈|이글스|라이온즈|자이언츠|타이거즈|다이노스|"
    r"두산|키움|SSG|한화|삼성|롯데|기아|KIA|엘지|엔씨|케이티|쓱",
    True,
)
CONCEPT = Pattern(
    "concept",
    r"몇\s*명|인원|정원|선수\s*수|포지션|수비\s*위치|공격\s*(?:과|와)\s*수비|"
    r"경기\s*방법|진행\s*방식|경기의?\s*목적|룰북|규칙집|몇\s*이닝|연장전|경기\s*시간",
)
OFF_DOMAIN = Pattern(
    "off",
    r"날씨|기온|미세먼지|장마|태풍|"
    r"파이썬|자바스크립트|자바|타입스크립트|리액트|알고리즘|프로그래밍|소스\s*코드|깃허브|SQL|"
    r"요리|레시피|김치찌개|파스타|볶음밥|"
    r"주식|코인|비트코인|환율|부동산|금리|적금|"
    r"번역해|영어로\s*해|일본어로|"
    r"축구|농구|배구|골프|테니스|배드민턴|리그오브레전드|롤드컵|이스포츠|"
    r"다이어트|병원|증상|처방|"
    r"웹툰|아이돌",
    True,
)
TOPICS = (
    Pattern("standings", r"순위|승률|몇\s*위|선두|1위|꼴찌|게임\s*차|순위표|가을야구"),
    Pattern(
        "schedule",
        r"일정|남은\s*경기|잔여\s*경기|다음\s*경기|경기\s*일정|몇\s*경기\s*남|"
        r"오늘.{0,8}경기|내일.{0,8}경기|언제\s*경기|경기\s*언제",
    ),
    Pattern("team_info", r"연고지|본거지|홈\s*구장|구장|창단|구단\s*정보|어느\s*도시|어디\s*연고"),
    Pattern(
        "roster",
        r"명단|로스터|선수단|엔트리|주요\s*선수|투수진|타선|불펜|선발진|타율\s*1위|홈런\s*1위|누가\s*뛰",
    ),
)
HIGHLIGHT = Pattern(
    "highlight",
    r"하이라이트|highlights?|H\s*[/.]\s*L|"
    r"풀\s*(?:영상|경기|하이라이트)|\d+\s*분\s*(?:하이라이트|요약)|"
    r"주요\s*장면|명장면|최고의\s*장면|"
    r"경기\s*(?:영상|요약|다시\s*보기)|다시\s*보기",
    True,
)
EXCLUDED_VIDEO = Pattern(
    "excluded",
    r"예고|프리뷰|preview|미리\s*보기|중계\s*안내|"
    r"인터뷰|기자\s*회견|브이로그|vlog|"
    r"응원|치어|팬\s*미팅|시구|이벤트|당첨|"
    r"생중계|LIVE\s*중계",
    True,
)
OFF_TOPIC_REFUSAL = "죄송하지만 저는 야구와 관련된 질문에 대해서만 답변할 수 있습니다."
NOT_IN_CONTEXT_REFUSAL = "죄송하지만 제공된 야구 자료에서는 해당 내용을 확인할 수 없습니다."
OFF_TOPIC = Pattern(
    "off_topic", r"죄송하지만\s*저는\s*야구와\s*관련된\s*질문에\s*대해서만\s*답변할\s*수\s*있습니다\s*\.?"
)
NOT_IN_CONTEXT = Pattern(
    "not_in_context", r"죄송하지만\s*제공된\s*야구\s*자료에서는\s*해당\s*내용을\s*확인할\s*수\s*없습니다\s*\.?"
)
WANTS_PITCHER = Pattern("wants_pitcher", r"투수|선발|불펜|마무리")
WANTS_HITTER = Pattern("wants_hitter", r"타자|타선|야수|포수|내야|외야")


def hit(text: Column, pattern: Pattern) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern.java)


def first_hit(text: Column, pattern: Pattern) -> Column:
    """The first matching text, null when nothing matches."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), pattern.java, 0)
    return F.nullif(found, F.lit(""))


def hits(text: Column, patterns: tuple[Pattern, ...]) -> Column:
    """Labels of the matching patterns, in table order."""
    return F.array_compact(F.array(*[F.when(hit(text, p), F.lit(p.label)) for p in patterns]))
