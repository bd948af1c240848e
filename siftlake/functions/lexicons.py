"""Word lists, patterns and thresholds that results depend on."""

# The lists below must be exactly these for right results.
NEGATIVE_KEYWORDS = [
    "crash", "crashes", "bug", "error", "issue", "not working", "not opening", "lag", "slow", "subscription", "paid",
    "cant", "doesn't", "problem", "annoying", "glitch", "freezes", "stuck", "broken", "fix", "terrible", "horrible",
    "awful", "worst", "hate", "bad", "useless", "waste", "refund", "delete",
]
POSITIVE_PATTERNS = [
    "good", "nice", "best", "very good", "superb", "amazing", "helpful", "awesome", "love this app", "great",
    "excellent", "perfect", "fantastic", "wonderful", "outstanding",
]
DEVICES = ["pixel", "samsung", "iphone", "galaxy", "oneplus", "xiaomi", "huawei", "oppo", "vivo", "realme", "nokia", "android", "ios"]
SEVERITY_TIERS = {
    "critical": ["crash", "crashes", "not working", "broken", "unusable"],
    "high": ["bug", "error", "issue", "problem", "glitch"],
    "medium": ["slow", "lag", "annoying", "confusing"],
}
PRIORITY_KEYWORDS = ["crash", "not working", "broken", "unusable", "bug", "error"]
RULE_KEYWORDS = [
    "crash", "crashes", "bug", "error", "issue", "problem", "not working", "doesnt work", "broken", "fix", "terrible",
    "horrible", "awful", "worst", "hate", "bad", "useless", "waste", "refund", "delete", "uninstall", "slow", "lag",
    "freeze", "stuck", "annoying", "glitch",
]
POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "awesome", "love", "perfect", "best", "fantastic", "wonderful", "nice",
    "enjoy", "helpful", "thanks", "thank", "appreciate", "easy", "simple", "fast", "smooth", "works",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "horrible", "worst", "hate", "sucks", "useless", "waste", "disappointed",
    "disappointing", "poor", "slow", "laggy", "annoying", "frustrating", "broken", "fail", "failed", "wrong",
]
COMPLAINT_VERBS = [
    "crash", "crashes", "crashed", "crashing", "freeze", "freezes", "froze", "hang", "hangs", "stuck", "break",
    "breaks", "broke", "broken", "fail", "fails", "failed", "failing", "stop", "stops", "stopped", "lose", "lost",
    "delete", "deleted", "remove", "removed", "disappear", "disappeared", "missing", "cant", "can't", "wont", "won't",
    "doesnt", "doesn't", "notworking",
]
BUG_KEYWORDS = ["bug", "error", "issue", "problem", "glitch", "defect", "fault", "crash", "freeze", "lag", "slow", "broken", "fix", "update needed"]
FEATURE_KEYWORDS = ["feature", "add", "please add", "would be nice", "suggestion", "should have", "needs", "missing", "wish", "hope", "could", "should"]
CONCESSIONS = ["but", "however", "although", "though", "still", "yet", "even though", "despite", "nevertheless", "nonetheless", "on the other hand", "that said", "except"]
FEATURE_REQUESTS = ["add", "improve", "support", "allow", "enable", "include", "need", "want", "wish", "hope", "please", "would like", "should add", "could add", "better if"]
MONETIZATION = ["limit", "limits", "limited", "free", "subscription", "price", "pay", "paid", "paywall", "expensive", "cost", "money", "premium", "trial", "upgrade", "unlock", "purchase"]
RETENTION = ["uninstall", "uninstalling", "delete", "deleting", "removing", "switching", "switch to", "leaving", "quit", "gave up", "stopped using", "no longer", "used to use", "abandoning"]
COMPARISONS = ["better than", "worse than", "compared to", "like", "similar to", "instead of", "prefer", "previous version", "old version", "used to"]
DETAILS = r"(?i)\b\d+\.\d+\.\d+\b|\b(android|ios|iphone|samsung|pixel|galaxy)\b|\b(button|menu|screen|page|tab|icon|feature)\b|\b(when|after|while|during|before)\b"
SARCASM = ["yeah right", "sure", "great job", "well done", "fantastic", "awesome", "perfect", "love it", "best ever", "amazing", "wonderful", "brilliant", "excellent"]
HOSTILE = [
    "crash", "bug", "broken", "waste", "terrible", "awful", "horrible", "useless", "worst", "fail", "problem", "issue",
    "error", "annoying", "disappointed", "frustrat", "angry", "hate", "regret", "refund",
]
CONTRADICTION = r"\b(?:but|however|although|yet)\b.*?(?:crash|bug|broken|waste|terrible|awful|horrible|useless|worst|fail)\b"
SPAM = [
    r"(?i)\b(?:https?://|www\.)\S+",
    r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    r"(?i)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"(?i)\b(?:click here|buy now|limited offer|act now)\b",
    r"(?i)\b(?:promo code|discount code|coupon)\b",
]
FINGERPRINT_FILLERS = ["the", "a", "an", "is", "are", "app", "issue", "problem", "with", "and", "of", "to"]
TITLE_STOP = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were",
    "not", "issue", "issues", "problem", "problems", "error", "errors", "app", "users", "user", "when", "after",
    "during", "while",
]
ANDROID_WORDS = ["samsung", "pixel", "oneplus", "xiaomi", "huawei", "oppo", "vivo", "realme", "nokia", "galaxy", "android"]
IOS_WORDS = ["iphone", "ios", "ipad"]
SCRIPTS = {
    "arabic": r"[\x{0600}-\x{06FF}]", "chinese": r"[\x{4e00}-\x{9fff}]", "japanese": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]",
    "korean": r"[\x{AC00}-\x{D7AF}]", "cyrillic": r"[\x{0400}-\x{04FF}]", "hindi": r"[\x{0900}-\x{097F}]",
    "bengali": r"[\x{0980}-\x{09FF}]", "thai": r"[\x{0E00}-\x{0E7F}]",
}
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
CATEGORIES = {
    "Crashes & Errors": ["crash", "crashing", "not open", "force close", "freeze", "stuck", "black screen", "not working", "broken"],
    "Performance": ["lag", "slow", "loading", "battery", "hang", "performance", "takes long", "drains"],
    "Ads": ["ad", "ads", "advertisement", "popup", "pop-up", "too many ads", "annoying ad", "banner"],
    "Login / Account": ["login", "sign in", "sign out", "account", "password", "otp", "verify", "logout", "session"],
    "Payments": ["pay", "paid", "purchase", "subscription", "refund", "charge", "money", "buy", "coin", "gem", "booster", "reward"],
    "Gameplay / Features": ["level", "game", "play", "lives", "score", "feature", "update", "new", "missing", "removed"],
    "UI / Design": ["ui", "design", "button", "screen", "dark mode", "interface", "look", "layout", "ugly", "beautiful"],
}
PRAISE_TITLE = r"(?i)\b(nice|good|great|excellent|love|like|awesome|amazing|perfect|best|fantastic|super|wonderful|fun|enjoy|enjoying|cool|helpful|useful|satisfied|happy|addictive|addicting)\b"
COMPLAINT_TITLE = r"(?i)\b(bad|crash|broken|bug|issue|problem|fail|hate|worst|terrible|slow|annoying|error|stuck|lag|freeze|glitch|ads?|money|scam|expensive|cheat|refund)\b"
CLUSTER_TYPES = [
    ("positive", r"\b(fun|enjoy|love|great|amazing|awesome|best|addictive|fantastic|wonderful|excellent|perfect|happy|like playing|keep playing|highly recommend|good game|good app|nice|brilliant|superb|entertaining|pleasant|satisfying|smooth)\b"),
    ("feature_request", r"\bplease add|would be nice|wish|could you add|want a feature|feature request|suggestion|add option|add a|would love|needs a|should have|missing option|allow us\b"),
    ("crash", r"\bcrash|crashing|force close|not open|freeze|stuck|black screen|keeps closing|app dies\b"),
    ("ad", r"\bad\b|ads|advertisement|rewarded video|ad sdk|ad fail|ad not|watching ad"),
    ("login", r"\blogin|sign in|sign out|account|password|otp|verify|logout|session expired|cant log\b"),
    ("payment", r"\bpay|paid|purchase|subscription|refund|charge|money|buy|billing|in-app purchase\b"),
    ("performance", r"\blag|slow|loading|battery|hang|performance|takes long|drains|fps|stutter|unresponsive\b"),
    ("ui", r"\bui|design|button|screen|dark mode|interface|layout|display|visual|broken ui|render|overlapping\b"),
    ("gameplay", r"\blevel|lives|score|feature|gameplay|missing feature|removed|update broke|progression|game mode\b"),
    ("complaint", r"\bannoy|disappointing|hate|terrible|worst|bad|too many|unfair|pay to win|expensive|greedy|boring|waste of time|garbage|useless|ridiculous|scam\b"),
]
HEADER_SYNONYMS = {
    "content": ["content", "contents", "text", "review", "reviewtext", "message", "comment", "feedback", "body", "tweet", "usercomment", "reviewcontent", "description"],
    "reviewId": ["reviewid", "id"], "userName": ["username", "author", "user"], "score": ["score", "rating", "stars", "rate"],
    "appVersion": ["appversion", "version"], "thumbsUpCount": ["thumbsupcount", "likes", "upvotes"],
}
