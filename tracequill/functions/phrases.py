"""Phrases of injection attempts by rule: each way to begin with each way to go on. Longer or other lists are a parameter of every scanner."""

from __future__ import annotations

#: Language or purpose: beginnings, ends, and what stands between them.
RULES = {
    "override": (("ignore", "disregard", "forget", "override", "bypass", "do not follow"), (
        "previous instructions", "prior instructions", "earlier instructions", "above instructions", "preceding instructions", "all previous", "all prior", "all preceding", "all earlier", "any previous", "all instructions", "all my instructions", "all restrictions", "all safety", "all rules", "all guidelines", "all filters",
        "your guidelines", "your instructions", "your training", "your rules", "your safety", "your system", "your constraints", "your restrictions", "your programming", "your ethical", "the rules", "the guidelines", "the instructions", "the above", "everything above", "everything before", "my instructions", "previous guidelines",
    ), " "),
    "switch off": (("disable", "turn off", "remove", "bypass", "deactivate"), ("safety filters", "all safety", "all filters", "content filters", "your filters", "your safety", "your restrictions", "all restrictions", "moderation", "guardrails"), " "),
    "persona": (("you are now", "pretend to be", "pretend you are", "roleplay as", "simulate being"), ("unrestricted", "an unrestricted", "unfiltered", "an unfiltered", "dan", "jailbroken", "an ai without", "free of", "evil"), " "),
    "leak": (("reveal", "print", "show me", "repeat", "output", "display", "tell me", "leak"), ("your system prompt", "your instructions", "your hidden prompt", "your initial prompt", "the system prompt"), " "),
    "no limits": (("you have no", "pretend you have no", "act as if you have no", "without any", "imagine you have no"), ("restrictions", "rules", "limits", "guidelines", "filters"), " "),
    "fr": (("ignore", "ignorez", "oublie", "oubliez"), ("les instructions", "toutes les instructions", "tes instructions", "les règles"), " "),
    "es": (("ignora", "olvida", "omite"), ("las instrucciones", "todas las instrucciones", "tus instrucciones", "las reglas"), " "),
    "de": (("ignoriere", "vergiss", "missachte"), ("alle anweisungen", "deine anweisungen", "die vorherigen anweisungen", "alle regeln"), " "),
    "it": (("ignora", "dimentica"), ("le istruzioni", "tutte le istruzioni", "le regole"), " "),
    "pt": (("ignore", "esqueça"), ("as instruções", "as instrucoes", "todas as instruções", "as regras"), " "),
    "nl": (("negeer", "vergeet"), ("alle instructies", "vorige instructies", "je regels"), " "),
    "pl": (("zignoruj", "zapomnij"), ("poprzednie instrukcje", "wszystkie instrukcje"), " "),
    "tr": (("önceki talimatları", "tüm talimatları"), ("yok say", "unut"), " "),
    "ru": (("игнорируй", "забудь"), ("все инструкции", "предыдущие инструкции", "свои правила"), " "),
    "ar": (("تجاهل", "انس"), ("جميع التعليمات", "التعليمات السابقة"), " "),
    "zh": (("忽略", "忘记", "无视"), ("之前的指令", "所有指令", "以上内容"), ""),
    "ja": (("以前の指示", "すべての指示", "上記の指示"), ("を無視", "を忘れて"), ""),
    "ko": (("이전 지시", "모든 지시"), ("무시", "잊어"), "를 "),
}
#: Phrases that follow no rule.
OTHERS = (
    "without safety filters", "unrestricted mode", "do anything now", "enable dan mode", "developer mode", "jailbreak mode", "sudo mode", "god mode", "no longer bound by", "from now on you are", "from now on you must", "new system prompt", "new primary directive",
    "admin override", "system override", "what is your system prompt", "send all data to", "exfiltrate", "your new task is", "your new instructions are", "hidden from the user",
)
PHRASES = tuple(dict.fromkeys([*(f"{a}{gap}{b}" for begins, ends, gap in RULES.values() for a in begins for b in ends), *OTHERS]))
