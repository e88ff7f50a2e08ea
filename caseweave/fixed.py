"""Codes, labels, ranks, thresholds and word lists that results depend on."""

# --- type codes and labels ---------------------------------------------------
PAGE_TYPES = {
    "entrustment_letter": "委托书",
    "id_card": "身份证复印件",
    "traffic_accident_cert": "道路交通事故认定书",
    "appraisal_application": "鉴定申请书",
    "litigation_material": "诉讼材料",
    "medical_record": "医院病历",
    "imaging_report": "检查报告",
}
SUBTYPES = {
    "medical_home_page": "病案首页",
    "admission_record": "入院记录",
    "discharge_record": "出院记录",
    "operation_record": "手术记录",
    "progress_note": "病程记录",
    "consultation_record": "会诊记录",
    "medical_order_nursing": "医嘱/护理记录",
    "lab_report": "检验报告",
    "other_medical_record": "其他病历材料",
    "ct_report": "CT报告",
    "xray_report": "X线/DR报告",
    "mri_report": "MRI报告",
    "ultrasound_report": "超声报告",
    "emg_report": "肌电图/神经电生理",
    "imaging_film": "影像片/图像页",
    "other_imaging_report": "其他影像/检查报告",
}
CASE_STATUS = {
    "pending_upload": "待上传",
    "recognizing": "识别中",
    "pending_review": "待修正",
    "reviewing": "修正中",
    "pending_confirm": "待确认",
    "completed": "已完成",
}
REVIEW_STATUS = ["pending", "system_verified", "confirmed", "needs_edit", "excluded"]
MANUAL_REVIEW = ["confirmed", "needs_edit", "excluded"]
IMPORTANCE = ["core", "supporting", "excluded"]
CANDIDATE_STATUS = ["pending", "accepted", "excluded", "needs_review"]
PROOFREAD_STATUS = ["pending", "processing", "completed", "needs_review", "failed"]

# --- ranks -------------------------------------------------------------------
STAGE_ORDER = {
    "entrustment_letter": 10,
    "id_card": 20,
    "traffic_accident_cert": 30,
    "litigation_material": 40,
    "appraisal_application": 50,
    "medical_record": 60,
    "imaging_report": 70,
}
CLOSING_TYPES = [
    "entrustment_letter",
    "id_card",
    "traffic_accident_cert",
    "litigation_material",
    "appraisal_application",
]
FACT_TYPE_RANK = {"hospital_record": 10, "medical_event": 20, "imaging_report": 30}
EVENT_RANK = {
    "admission": 10,
    "diagnosis": 20,
    "exam": 30,
    "surgery": 40,
    "treatment": 50,
    "progress": 60,
    "medication": 70,
    "consultation": 80,
    "discharge": 90,
    "other": 100,
}
EVENT_LABELS = {
    "admission": "入院",
    "discharge": "出院",
    "surgery": "手术",
    "progress": "病程",
    "consultation": "会诊",
    "exam": "检查",
    "treatment": "治疗",
    "medication": "用药",
    "diagnosis": "诊断",
    "other": "其他",
}
CORE_ROLES = ["admission", "discharge", "surgery", "diagnosis", "exam"]

# --- sentinels ---------------------------------------------------------------
NO_TIME = "9999-99-99 99:99"
NO_DAY = "9999-99-99"
NO_PAGE = 999999

# --- words used by the scalar functions --------------------------------------
ORG_SUFFIXES = ["人民医院", "中心医院", "中医院", "医院", "卫生院"]
UNKNOWN_ORG = "未识别医院"
FORMAL_NUMERALS = ["零", "壹", "贰", "叁", "肆", "伍", "陆", "柒", "捌", "玖", "拾"]
SECTION_NUMERALS = ["（一）", "（二）", "（三）", "（四）", "（五）", "（六）", "（七）", "（八）", "（九）", "（十）"]
TRUNCATION_MARK = "\n\n[... 输入过长，已截断 ...]"
STOP_LABELS = [
    "姓名", "性别", "年龄", "科室", "科室名称", "住院科室", "病床号", "床位号", "住院号", "入院日期", "入院时间", "出院日期", "出院时间",
    "住院天数", "实际住院", "主诉", "现病史", "入院情况", "既往史", "体格检查", "专科检查", "辅助检查", "入院诊断", "初步诊断", "修正诊断",
    "术前诊断", "术中诊断", "术后诊断", "手术日期", "手术时间", "手术名称", "麻醉方式", "术中所见", "手术经过", "手术过程", "诊疗经过",
    "治疗经过", "出院诊断", "出院情况", "出院医嘱", "医师签字", "手术者签名", "医生签字", "记录时间",
]
RECORD_STOP_LABELS = [
    "姓名", "性别", "年龄", "科室", "科室名称", "住院科室", "病床号", "床位号", "住院号", "入院日期", "入院时间", "出院日期", "出院时间",
    "住院天数", "实际住院", "主诉", "现病史", "既往史", "传染病史", "预防接种史", "手术史", "输血史", "个人史", "婚育史", "家族史", "体格检查",
    "专科检查", "辅助检查", "入院诊断", "诊疗经过", "治疗经过", "出院诊断", "出院情况", "出院医嘱", "医师签字", "手术记录",
]
NUMBERED_TITLE_LIMIT = 90
HEADING_LINE_LIMIT = 120

# --- text for the assembled reports ------------------------------------------
DEFAULT_PERSON = "被鉴定人"
UNDATED = "日期未明"
UNCLEAR = "未明"
PLACEHOLDERS = {
    "entrusting_unit": "待填写",
    "request": "待填写",
    "case_facts": "待根据事故认定书等材料填写...",
    "material_summary": "待根据病历材料填写...",
    "appraisal_process": "根据《司法鉴定程序通则》及相关鉴定标准，对被鉴定人进行了法医临床检验。",
    "analysis": "【分析说明由鉴定人根据检验结果和专业标准填写】",
    "opinion": "【鉴定意见由鉴定人根据分析说明和专业标准填写】",
}
NO_REFERENCES = "未检索到可用规范依据。"

# --- event proposal ----------------------------------------------------------
AUTO_FLAG = "auto_event"
FALLBACK_FLAG = "rule_fallback_from_ocr"

# Candidates and checks of the analysis text (fixed values).
CANDIDATE_DEFAULTS = {"grade": "需人工核对", "suggestion": "需人工核对", "reason": "材料中存在相关事实，但仍需结合条款成立条件人工核对。"}
PERIOD_GRADE = "三期范围"
PERIOD_CATEGORY = "三期"
PERIOD_TERMS = ["误工", "护理", "营养"]
COUNT_UNKNOWN = "不明"
CODE_CONFLICTS = [("hip_joint_replacement", "5.9.2", "髋", "髋关节置换候选已满足，但文本中出现 5.9.2，请人工核对条款号是否误引。")]
FALLBACK_WARNING = "LLM 输出含候选清单或工作痕迹，已改用已采信事实生成保守版分析说明。"

# --- fixed values: requests and names --------------------------------------
REQUEST_HEADINGS = ["鉴定要求", "鉴定事项", "委托鉴定事项", "委托事项", "鉴定项目"]
REQUEST_STOPS = [
    "现将", "请根据", "鉴定完毕", "委托书和相关材料", "相关材料移交", "督办人", "联系电话", "联系人", "年月日",
]
# Similarity of names: thresholds of common runs and the scores they give.
NAME_SCORES = {"long_run": 4, "short_run": 3, "contained": 0.82, "base": 0.68, "slope": 0.28, "most": 0.96, "same_suffix": 0.86}

# --- fixed values: corpus search -------------------------------------------
# (words asked for, words of the name): +8 each
BOOST_RULES = [
    (["伤残", "致残", "残疾", "十级", "九级", "八级"], ["人体损伤致残程度分级"]),
    (["误工", "护理期", "营养期", "三期"], ["误工期", "护理期", "营养期"]),
    (["护理依赖"], ["护理依赖"]),
    (["因果", "参与度"], ["因果关系"]),
    (["损伤程度", "轻伤", "重伤", "轻微伤"], ["人体损伤程度鉴定标准"]),
    (["影像", "CT", "MRI", "DR", "X线"], ["影像学检验", "法医影像学"]),
    (["关节", "活动度"], ["关节活动度"]),
    (["听觉", "听力"], ["听觉功能障碍"]),
    (["视觉", "视力"], ["视觉功能障碍"]),
    (["神经", "周围神经"], ["周围神经功能障碍"]),
    (["癫痫"], ["外伤性癫痫"]),
    (["劳动能力", "工伤", "职业病"], ["劳动能力鉴定", "职工工伤"]),
]
# (words of the name, words of the query, wanted, points)
BOOST_SPECIALS = [
    (["人身保险"], ["保险"], False, -20.0),
    (["劳动能力"], ["劳动", "工伤", "职业病"], False, -12.0),
    (["人体损伤致残程度分级"], ["伤残", "致残", "残疾"], True, 18.0),
    (["人体损伤程度鉴定标准"], ["损伤程度", "轻伤", "重伤", "轻微伤"], True, 18.0),
]
CONTEXT_BUDGETS = {"primary": 4200, "supporting": 1600, "candidate": 900}
CONTEXT_HEADS = {
    "primary": "【拟引用规范依据】（正式结论只能引用本栏条款，不得引用未列出的条款号）",
    "supporting": "\n【辅助判断依据】（只用于影像复核、事实判断，不得直接写成伤残等级或三期条款依据）",
    "candidate": "\n【低置信候选依据】（仅提示人工核对，正文不得直接引用）",
}
NO_PRIMARY = "未检索到拟引用条款，正式结论应采用审慎表述。"
EVIDENCE_BONUS = [(["全髋关节置换", "髋关节置换", "人工关节", "股骨头置换"], 14), (["骨痂", "畸形愈合"], 5), (["已施手术", "手术开始时间"], 4)]

# --- fixed values: candidates and the analysis text ------------------------
WARN_UNCERTAIN = "该候选证据不足或条款映射未稳定，不能直接写成正式结论。"
WARN_UNREVIEWED = "部分来源事实尚未人工确认。"
WARN_NO_PAGES = "部分来源缺少页码，建议回到原图核对。"
FOLLOWUP_TERMS = ["后续治疗费", "后续治疗费用", "后期医疗费用", "后期治疗费", "医疗费用", "后续治疗项目"]
OPENERS = ["根据委托单位提供的现有材料", r"1\.\s*被鉴定人"]

# --- fixed values: labels of fields ----------------------------------------
RECORD_LABELS = {
    # column: (labels, longest)
    "number": (["住院号", "病案号"], 80),
    "complaint": (["主诉"], 300),
    "history": (["现病史", "入院情况"], 900),
    "exam": (["体格检查", "专科检查"], 900),
    "diagnosis_in": (["入院诊断"], 800),
    "treatment": (["诊疗经过", "治疗经过"], 900),
    "diagnosis_out": (["出院诊断"], 800),
    "orders": (["出院医嘱"], 900),
}
EVENT_FIELD_LABELS = {
    "complaint": (["主诉"], 260),
    "history": (["现病史", "入院情况"], 650),
    "diagnosis_in": (["入院诊断", "初步诊断"], 650),
    "exam": (["体格检查", "专科检查"], 650),
    "quote": (["主诉", "现病史", "入院情况"], 500),
}
DISCHARGE_LABELS = {
    "diagnosis_out": (["出院诊断"], 650),
    "treatment": (["诊疗经过", "治疗经过"], 700),
    "orders": (["出院医嘱"], 700),
    "state": (["出院情况"], 500),
    "quote": (["出院诊断", "出院医嘱"], 500),
}
SURGERY_DATES = ["手术开始", "手术开始时间", "手术时间", "手术日期"]
SURGERY_LABELS = {
    "surgery": (["手术名称", "手术及操作名称", "拟实施手术"], 240),
    "diagnosis": (["术前诊断", "术中诊断", "术后诊断"], 650),
    "findings": (["术中所见"], 650),
    "treatment": (["手术经过、术中发现的情况及处理", "手术经过", "手术过程"], 900),
}
EVENT_SUBTYPES = ["admission_record", "medical_home_page", "operation_record", "discharge_record", "progress_note"]
