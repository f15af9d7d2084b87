"""Keyword lists, templates and denied phrases (fixed values)."""

SCREENING_KEYWORDS = [
    "spot-mas", "spot mas", "spotmas", "galleri", "cfdna", "ctdna", "methylation", "mced", "screening",
    "cell-free dna", "cell free dna", "liquid biopsy", "circulating tumor", "multi-cancer",
    "tầm soát ung thư", "phát hiện sớm", "chưa phát hiện",
]
HPLC_KEYWORDS = [
    "hba1c", "hb a1c", "a1c", "ifcc", "ngsp", "eag", "estimated average glucose", "hemoglobin a1c",
    "glycated", "electrophoresis", "hplc", "đường huyết trung bình",
]
HORMONE_KEYWORDS = [
    "testosterone", "estradiol", "progesterone", "fsh", "lh", "prolactin", "cortisol", "dhea", "tsh",
    "free t3", "free t4", "anti-mullerian", "amh", "inhibin",
]
APPENDIX_KEYWORDS = [
    "methodology", "procedure", "specimen requirement", "certification", "accreditation", "note:",
    "disclaimer", "phương pháp", "quy trình",
]

# accepted words in a result field
QUALITATIVE_WORDS = [
    "positive", "negative", "reactive", "non-reactive", "nonreactive", "normal", "abnormal", "detected",
    "not detected", "trace", "present", "absent", "borderline", "indeterminate", "equivocal", "high", "low",
    "moderate", "mild", "severe", "clear", "cloudy", "turbid", "hazy", "amber", "yellow", "straw",
    "+", "++", "+++", "++++", "1+", "2+", "3+", "4+", "âm tính", "dương tính", "négatif", "positif",
]
# name patterns that mark a metadata row
METADATA_NAME_PATTERNS = [r":\s*$", r"(?i)exact name as printed", r"^\d{2}[-/]\d{2}[-/]\d{4}", r"(?i)^interpretation$"]
DATE_VALUE_PATTERN = r"^\d{2}[-/]\d{2}[-/]\d{2,4}$"

# words that mark a threshold-style reference text
THRESHOLD_WORDS = ["desirable", "optimal", "borderline", "risk", "target", "acceptable", "ideal", "goal",
                   "category", "prediabetes", "diabetes", "normal:"]

NORMAL_WORDS = ["negative", "non-reactive", "nonreactive", "not detected", "absent", "clear", "âm tính", "négatif"]
ABNORMAL_WORDS = ["positive", "reactive", "abnormal", "detected", "present", "dương tính", "positif"]
GRADE_ORDER = ["trace", "1+", "2+", "3+", "4+"]

# screening attachments
SCREENING_TYPES = [
    ("SPOT-MAS", ["spot-mas", "spot mas", "spotmas"]),
    ("Galleri", ["galleri"]),
    ("MCED", ["mced", "multi-cancer early detection"]),
    ("cfDNA", ["cfdna", "cell-free dna", "cell free dna"]),
    ("ctDNA", ["ctdna", "circulating tumor dna"]),
]
NOT_DETECTED_PHRASES = ["not detected", "negative", "no signal", "no abnormality", "không phát hiện"]
DETECTED_PHRASES = ["detected", "positive", "signal detected", "phát hiện"]
NON_ORGAN_TERMS = ["multiple cancers", "asymptomatic adults", "multiple organs", "general screening",
                   "various cancers", "screening"]

# personal data patterns, applied in order
REPORT_PII = [
    (r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b", "[SSN]"),
    (r"\b[A-Z][a-z]+,?\s+[A-Z][a-z]+\b", "[NAME]"),
    (r"\b\d{10,}\b", "[ID]"),
    (r"\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", "[PHONE]"),
]
QUESTION_PII = [
    (r"(?i)\b[\w._%+-]+@[\w.-]+\.[A-Z]{2,}\b", "[email]"),
    (r"\b(?:\+?\d{1,3}[\s-]?)?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{4}\b", "[phone]"),
]

# diagnostic wording denied in answers
ANSWER_DENIED = [r"\byou have\b", r"\byou are diagnosed\b", r"\bdiagnosed with\b", r"\bdefinitely indicates\b",
                 r"\bmeans you have\b", r"\bconfirmed (?:case of |that you have )", r"\bproves\b"]
# diagnostic wording denied in headlines
HEADLINE_DENIED = [r"\byou have\b", r"\byou are diagnosed\b", r"\bdiagnosed with\b", r"\bconfirmed\b",
                   r"\bdefinitely indicates\b", r"\bdefinitely\b", r"\bmeans you have\b", r"\bproves\b"]
HEADLINE_ALARMIST = [r"\bclinical attention\b", r"\bmedically concerning\b", r"\brequires? evaluation\b",
                     r"\burgent\b", r"\balarming\b"]
HEADLINE_DRUGS = [
    "metformin", "insulin", "statin", "atorvastatin", "rosuvastatin", "lisinopril", "amlodipine", "metoprolol",
    "warfarin", "aspirin", "ibuprofen", "acetaminophen", "paracetamol", "omeprazole", "levothyroxine",
    "amoxicillin", "azithromycin", "ciprofloxacin", "prednisone", "hydrocortisone", "albuterol", "fluoxetine",
    "sertraline",
]
STATUS_WORDS = {
    "yellow": ["watch", "monitor", "follow", "minor", "mild", "review", "mostly"],
    "orange": ["monitor", "follow", "watch", "review", "discuss"],
    "red": ["follow", "discuss", "review", "stand", "important", "promptly"],
    "green": [],
}
HEADLINE_ANALYTES = ["ldl", "hdl", "hba1c", "tsh", "alt", "ast", "alp", "ggt", "creatinine", "eag", "ifcc",
                     "ngsp", "ferritin", "ck"]
ANSWER_DOSE = r"(?i)\b\d+\s*(mg|mcg|μg|ug|g|ml|iu|units?)\b(?!/)"
HEADLINE_DOSE = r"(?i)\b\d+\s*(mg|mcg|μg|g|ml|iu|units?)\b"
COMPARATIVE_RATIO = r"(?i)\b\d+(?:\.\d+)?\s*(?:×|x|times)\s*(?:normal|the (?:upper|lower) (?:limit|range|bound))"
TIMEFRAME_PATTERNS = [r"(?i)\b\d+\s*(?:weeks?|months?|days?|years?)\b",
                      r"(?i)\b\d+\s*-\s*\d+\s*(?:weeks?|months?|days?|years?)\b",
                      r"(?i)\bage\s*\d+\b"]
DIGIT_PAIR = r"\b\d{1,6}-\d{1,3}\b"
ROLE_PREFIX = r"(?i)^\s*(system|assistant|user)\s*:"

HEADLINES = {
    "green": "Most results are within expected range.",
    "yellow": "Most results are normal; a few are mildly outside the usual range.",
    "orange": "Most results are normal; a few are worth follow-up or monitoring.",
    "red": "A few results stand out and may need follow-up with your clinician.",
}

DISCLAIMERS = {
    "en": "This information is for educational purposes only and does not replace professional medical advice. "
          "Please consult your healthcare provider for interpretation of your results.",
    "fr": "Ces informations sont fournies à titre éducatif uniquement et ne remplacent pas un avis médical professionnel. "
          "Veuillez consulter votre médecin pour l'interprétation de vos résultats.",
    "ar": "هذه المعلومات لأغراض تعليمية فقط ولا تحل محل المشورة الطبية المهنية. "
          "يرجى استشارة مقدم الرعاية الصحية الخاص بك لتفسير نتائجك.",
    "vn": "Thông tin này chỉ mang tính chất giáo dục và không thay thế lời khuyên y tế chuyên nghiệp. "
          "Vui lòng tham khảo ý kiến bác sĩ để được giải thích kết quả.",
}

VALIDATOR_REASONS = ["invented_number", "comparative_ratio", "invalid_cite", "citation_shape", "citation_empty",
                     "schema_invalid"]
OUT_OF_SCOPE = {
    "en": "I can only help interpret what is in this report. For that, please consult your doctor.",
    "vn": "Tôi chỉ có thể hỗ trợ giải thích những gì có trong báo cáo này. Vui lòng tham khảo ý kiến bác sĩ.",
    "fr": "Je peux uniquement aider à interpréter ce qui figure dans ce rapport. Pour cela, veuillez consulter votre médecin.",
    "ar": "أستطيع المساعدة فقط في تفسير ما في هذا التقرير. لذلك، يرجى استشارة طبيبك.",
}
VALIDATOR_FAIL = {
    "en": "I had trouble answering that one. Try rephrasing — for example: \"What in my report should I focus on first?\"",
    "vn": "Tôi gặp khó khăn khi trả lời câu này. Hãy thử diễn đạt lại — ví dụ: \"Tôi nên tập trung vào điều gì trước?\"",
    "fr": "J'ai eu du mal à répondre. Essayez de reformuler — par exemple : « Sur quoi me concentrer en premier ? »",
    "ar": "واجهت صعوبة في الإجابة على ذلك. حاول إعادة الصياغة — مثلاً: \"بماذا أبدأ التركيز؟\"",
}
FOLLOW_UPS = {
    "en": ["Which results are out of range?", "What should I focus on first?", "Do I need to see a doctor?"],
    "vn": ["Kết quả nào nằm ngoài khoảng?", "Tôi nên tập trung vào điều gì trước?", "Tôi có cần đi khám bác sĩ không?"],
    "fr": ["Quels résultats sont hors plage ?", "Sur quoi me concentrer en premier ?", "Dois-je consulter un médecin ?"],
    "ar": ["أي النتائج خارج النطاق؟", "بماذا أبدأ التركيز؟", "هل أحتاج لرؤية طبيب؟"],
}

RETRIEVAL_QUERIES = {
    "hplc_diabetes_block": "HbA1c diabetes monitoring hemoglobin A1c patient education blood sugar management",
    "screening_attachment": "ctDNA liquid biopsy cancer screening results meaning limitations false negative",
}

EXPORT_COLUMNS = ["test_name", "value", "unit", "direction", "severity", "classification_state", "is_panic",
                  "actionability", "confidence", "reference_range_low", "reference_range_high", "range_source",
                  "range_trust"]
AUDIT_COLUMNS = ["test_name", "value", "unit", "direction", "severity", "is_panic", "actionability", "confidence",
                 "reference_range_low", "reference_range_high", "range_source", "range_trust", "loinc_code",
                 "section_type", "verification_verdict", "unit_confidence"]
