"""Rule-based turn classification as one CASE expression per role."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, estimate_tokens

USER_INTENTS = ["ask", "instruct", "clarify", "correct", "retry", "continue", "ack", "context"]
REPLY_INTENTS = ["answer", "code", "followup_question", "apology_fix", "refusal"]

# --- fixed values: patterns that must equal the published rules ----------------------------
ACK = (
    r"^\W*(thanks?( you)?|thx|ty|ok(ay)?|cool|great|nice|perfect|awesome|got it|good|lol|haha)\W*$",
    r"^\W*(감사(합니다|해요)?|고마워(요)?|고맙습니다|ㄳ|ㄱㅅ|오케이|ㅇㅋ|좋아(요)?|굿|알겠(어|습니다)(요)?|넵|네+|응+|ㅎㅎ+|ㅋㅋ+)\W*$",
)
CONTINUE = (
    r"^\W*(continue|go on|keep going|more|next|and\??|proceed)\W*$",
    r"^\W*(계속(해(줘|주세요)?)?|이어서(\s*(해줘|써줘|작성해줘))?|더|다음|진행(해줘)?)\W*$",
)
CORRECT = (
    r"^\W*no\b", r"\bthat'?s (not|wrong)\b",
    r"\b(wrong|incorrect|doesn'?t work|not working|still (not|broken|wrong)|didn'?t work)\b",
    r"\bnot what i\b", r"\btry again\b", r"\byou (missed|forgot|ignored)\b", r"\bi said\b",
    r"\bstill (getting|the same)\b",
    r"^\W*아니", r"틀렸", r"틀린", r"잘못", r"그게 아니", r"다시 (해|작성|써|만들)", r"안 ?(돼|되|됨|된다)",
    r"오류", r"에러", r"말했잖", r"이해를 못", r"여전히", r"엉뚱",
)
CLARIFY = (
    r"^\W*(also|and also|but|however|additionally|actually|only|make it|instead|what if)\b",
    r"\b(in addition|one more thing|more specifically)\b",
    r"^\W*(그리고|추가로|단,?|대신|그럼|그러면|좀 더|조금 더|더 자세히|구체적으로|만약)",
)
QUESTION = (
    r"\?\s*$", r"^\W*(what|why|how|when|where|which|who|is|are|can|could|should|does|do)\b",
    r"(까요|나요|인가요|ㄹ까|는지|을까|가요|니\?|냐)\W*$",
)
APOLOGY = (
    r"^\W*(you'?re (absolutely )?right|my apologies|apologies|i apologi[sz]e|sorry)",
    r"^\W*(죄송합니다|맞습니다|말씀하신 대로|정확한 지적|사과드립니다)",
)
REFUSAL = (
    r"^\W*(i can'?t|i cannot|i'?m (not able|unable)|i won'?t)",
    r"(도와드릴 수 없|제공할 수 없|답변드릴 수 없)",
)
GRATITUDE = (
    r"(?iU)^\W*(thanks?( a lot| so much| you( so much| very much)?)?|thx|ty|many thanks|cheers|much appreciated|"
    r"감사(합니다|해요|드립니다)?|고마워(요)?|고맙습니다|ㄳ|ㄱㅅ|"
    r"ありがとう(ございます)?|谢谢|多谢|merci( beaucoup)?|gracias|danke( schön)?|obrigad[oa])"
    r"[\s!.~♡❤️😊🙏👍]*$"
)
READ_COMMAND = (
    r"(?U)^\s*(?:cd\s+\S+\s*(?:&&|;)\s*)?(?:cat|head|tail|less|sed\s+-n|grep|egrep|rg|ag|find|ls|tree|wc|jq|"
    r"git\s+(?:log|show|diff|status|grep|ls-files|blame))\b"
)
# ---------------------------------------------------------------------------------------------


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?iU)" + "|".join(patterns))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _asks(t: Column) -> Column:
    tail = F.substring(t, F.greatest(F.length(t) - 199, F.lit(1)), F.lit(200))
    return _matches(tail, QUESTION) | _matches(F.substring(t, 1, 80), QUESTION)


def user_intent(text, tokens, similar, code, first) -> Column:
    t, tokens = _strip(col(text)), col(tokens)
    similar, code, first = col(similar), col(code), col(first)
    pasted = (tokens >= 600) | (code & (tokens >= 250))
    asks = F.when(_asks(t), "ask").otherwise("instruct")
    return (
        F.when(first, F.when(pasted, "context").otherwise(asks))
        .when(similar & (tokens > 3), "retry")
        .when((tokens <= 12) & _matches(t, ACK), "ack")
        .when((tokens <= 12) & _matches(t, CONTINUE), "continue")
        .when(pasted, "context")
        .when(_matches(F.substring(t, 1, 240), CORRECT), "correct")
        .when(_matches(F.substring(t, 1, 120), CLARIFY), "clarify")
        .otherwise(asks)
    )


def reply_intent(text, tokens, code) -> Column:
    t, tokens, code = _strip(col(text)), col(tokens), col(code)
    head = F.substring(t, 1, 200)
    return (
        F.when(_matches(head, APOLOGY), "apology_fix")
        .when(_matches(head, REFUSAL) & (tokens < 300), "refusal")
        .when((tokens < 120) & t.endswith("?"), "followup_question")
        .when(code, "code")
        .otherwise("answer")
    )


def is_gratitude(text) -> Column:
    t = col(text)
    return F.coalesce((t != "") & (estimate_tokens(t) <= 12) & _strip(t).rlike(GRATITUDE), F.lit(False))


def is_read_command(command) -> Column:
    return F.coalesce(col(command).rlike(READ_COMMAND), F.lit(False))
