"""The default word lists. Every operator takes its own lists as parameters."""

BODY_PARTS = [
    "胫腓骨", "胫骨", "腓骨", "骨盆", "髂骨", "骶骨", "耻骨", "坐骨", "股骨", "髋", "小腿", "下肢", "肋骨",
    "锁骨", "肩胛骨", "肩", "颅脑", "头颅", "额部", "胸部", "腹部", "上腹部", "下腹部", "脾", "膝", "踝", "足",
]
PART_PARENTS = {
    "胫骨": "胫腓骨", "腓骨": "胫腓骨", "耻骨": "骨盆", "坐骨": "骨盆", "骶骨": "骨盆", "髂骨": "骨盆", "小腿": "下肢",
}
CORE_WORDS = [
    "骨折", "破裂", "损伤", "出血", "血肿", "脾", "肋骨", "股骨", "锁骨", "颅脑", "手术", "内固定", "置换", "切除", "修补",
]
POSITIVE_WORDS = [
    "骨折", "断裂", "内固定", "置换", "骨痂", "缺如", "缺失", "破裂", "裂伤", "血肿", "出血", "积液", "挫伤", "术后", "修补", "脱落",
]
HEDGING_WORDS = ["未见明显异常", "未见异常", "未见明确", "考虑", "疑似", "待排", "建议复查"]
LAB_WORDS = [
    "血常规", "尿常规", "凝血", "肝功能", "肾功能", "电解质", "葡萄糖", "白蛋白", "胆红素", "乙型肝炎", "丙型肝炎", "梅毒",
    "HIV", "免疫缺陷病毒", "检验报告", "检验项目",
]
EXAM_WORDS = ["CT", "DR", "MRI", "X线", "CR", "超声", "彩超", "B超", "磁共振", "平片"]
EXAM_ALIASES = {"磁共振": "MRI", "彩超": "超声", "B超": "超声"}
RELEVANT_WORDS = [
    "车祸", "外伤", "交通事故", "骨折", "损伤", "破裂", "出血", "血肿", "挫伤", "胫骨", "腓骨", "胫腓骨", "骨盆", "骶骨",
    "耻骨", "坐骨", "股骨", "髋", "肋骨", "锁骨", "颅脑", "脾", "腹", "胸", "手术", "内固定", "外固定", "复位", "切除",
    "修补", "置换", "陪护", "功能锻炼", "复查",
]
LOW_VALUE_SUBTYPES = ["consultation_record", "medical_order_nursing", "lab_report", "other_medical_record"]

# Rule tables of the page classifier, in the order in which they are tried.
SUBTYPE_RULES = {
    "medical_record": [
        ("medical_home_page", ["住院病案首页", "病案首页", "医疗付费方式", "病案号"]),
        ("discharge_record", ["出院记录", "出院小结", "出院（小结）记录", "出院(小结)记录", "出院诊断", "出院医嘱"]),
        ("operation_record", ["手术记录", "手术日期", "手术名称", "术中诊断", "手术经过", "麻醉方式"]),
        ("consultation_record", ["会诊申请单", "会诊记录", "会诊目的", "会诊科室", "会诊医师", "会诊意见"]),
        ("admission_record", ["入院记录", "入院时间", "入院情况", "主诉", "现病史"]),
        ("progress_note", ["首次病程记录", "日常病程记录", "病程记录", "主任医师查房记录", "上级医师查房记录"]),
        ("medical_order_nursing", ["长期医嘱", "临时医嘱", "医嘱单", "护理记录", "体温单", "护理评估"]),
        ("lab_report", ["检验报告", "检验项目", "参考范围", "血常规", "尿常规", "生化", "凝血", "D-二聚体"]),
    ],
    "imaging_report": [
        ("emg_report", ["肌电图", "神经电图", "神经肌电图", "运动传导", "感觉传导", "F波", "H反射", "肌电图测定"]),
        ("mri_report", ["MRI", "磁共振", "核磁共振"]),
        ("ultrasound_report", ["彩超", "超声", "B超"]),
        ("ct_report", ["CT", "计算机断层", "三维重建"]),
        ("xray_report", ["DR", "CR", "X线", "X光", "摄片", "平片"]),
        ("other_imaging_report", ["影像表现", "诊断意见", "报告医师", "审核医师", "检查项目", "检查时间"]),
        ("imaging_film", ["图片", "运动曲线", "感觉曲线", "曲线"]),
    ],
}
SUBTYPE_DEFAULTS = {"medical_record": "other_medical_record", "imaging_report": "other_imaging_report"}
HEADER_RULES = [
    ("medical_home_page", ["住院病案首页", "病案首页"]),
    ("admission_record", ["入院记录"]),
    ("discharge_record", ["出院记录", "出院小结", "出院（小结）记录", "出院(小结)记录"]),
    ("operation_record", ["手术记录"]),
    ("consultation_record", ["会诊申请单", "会诊记录"]),
    ("progress_note", ["首次病程记录", "日常病程记录", "病程记录"]),
    ("medical_order_nursing", ["长期医嘱", "临时医嘱", "医嘱单", "护理记录"]),
]
MEDICAL_HITS = [
    "住院病案首页", "病案首页", "入院记录", "出院记录", "出院小结", "出院（小结）记录", "手术记录", "病程记录", "会诊申请单",
    "会诊记录", "医嘱单", "护理记录", "检验报告", "主诉", "现病史", "出院诊断",
]
IMAGING_HITS = [
    "CT", "DR", "CR", "X线", "MRI", "磁共振", "超声", "彩超", "肌电图", "神经电图", "运动传导", "感觉传导", "影像表现",
    "诊断意见", "检查项目", "报告医师",
]
LAB_HITS = [
    "检验报告", "检验报告单", "标本类型", "标本类别", "样本类型", "参考范围", "血常规", "尿常规", "生化", "凝血", "D-二聚体",
]
LAB_TITLES = ["检验报告", "检验报告单"]
LAB_EVIDENCE = ["标本类型", "标本类别", "样本类型", "参考范围", "送检科室", "样本号", "标本号"]
LAB_ITEMS = ["血常规", "尿常规", "生化", "凝血", "D-二聚体", "白细胞", "红细胞", "血红蛋白"]
MODALITY_WORDS = {
    "ct_report": ["CT", "计算机断层", "三维重建"],
    "xray_report": ["DR", "CR", "X线", "X光", "摄片", "平片"],
    "mri_report": ["MRI", "磁共振", "核磁共振"],
    "ultrasound_report": ["彩超", "超声", "B超"],
    "emg_report": ["肌电图", "神经电图", "神经肌电图", "运动传导", "感觉传导"],
}
MODALITY_DEFAULT = ["检查报告", "检查项目"]
REPORT_STRUCTURE = [
    "影像表现", "影像诊断", "诊断意见", "检查项目", "检查部位", "报告医师", "审核医师", "检查号", "报告时间", "检查时间",
]
CONTINUATION_TITLES = [
    "司法鉴定委托书", "居民身份证", "道路交通事故认定书", "鉴定申请书", "民事起诉状", "住院病案首页", "入院记录", "出院记录",
    "手术记录", "病程记录", "会诊", "CT", "MRI", "X线", "超声", "肌电图",
]
STANDALONE_TITLES = {
    "entrustment_letter": ["司法鉴定委托书"],
    "id_card": ["居民身份证"],
    "traffic_accident_cert": ["道路交通事故认定书"],
    "litigation_material": ["民事起诉状"],
    "appraisal_application": ["鉴定申请书"],
    "medical_record": [
        "住院病案首页", "病案首页", "入院记录", "出院记录", "出院小结", "手术记录", "病程记录", "会诊申请单", "会诊记录",
    ],
    "imaging_report": [
        "检验报告", "检验报告单", "CT", "DR", "CR", "X线", "MRI", "磁共振", "超声", "彩超", "肌电图", "影像表现", "诊断意见",
    ],
}
LETTER_WORDS = ["司法鉴定委托书", "委托贵机构予以鉴定", "鉴定要求"]
ID_WORDS = ["居民身份证", "公民身份号码", "签发机关", "中华人民共和国"]
LITIGATION_WORDS = [
    "民事起诉状", "诉讼请求", "原告", "被告", "具状人", "证据清单", "残疾赔偿金", "精神损害赔偿金", "交通事故发生情况",
]
CERTIFICATE_WORDS = ["道路交通事故认定书", "交通事故发生经过", "道路交通事故基本事实", "事故形成原因分析", "当事人导致交通事故"]
CERTIFICATE_FACTS = ["道路交通事故基本事实", "事故形成原因分析", "交通事故发生经过"]
CERTIFICATE_LAW = ["当事人导致交通事故", "交通事故成因", "道路交通安全法"]
APPLICATION_WORDS = ["鉴定申请书", "申请事项", "事实与理由", "申请人"]

# Request topics: any of the words, none of the second list.
REQUEST_TOPICS = {
    "disability": (["伤残", "残疾", "致残", "伤残等级"], []),
    "work_loss": (["误工"], []),
    "nursing": (["护理"], ["护理依赖"]),
    "nutrition": (["营养"], []),
    "nursing_dependency": (["护理依赖"], []),
    "followup_cost": (["后续治疗", "后期治疗", "医疗费", "治疗费"], []),
    "causation": (["因果", "参与度", "关系"], []),
}
KEYWORD_BANK = [
    "伤残", "残疾", "致残", "损伤程度", "轻伤", "重伤", "轻微伤", "误工期", "护理期", "营养期", "护理依赖", "后续治疗",
    "医疗损害", "因果关系", "外伤参与度", "关节活动度", "视觉", "视力", "听觉", "听力", "周围神经", "神经功能", "癫痫",
    "影像学", "X线", "DR", "CT", "MRI", "骨折", "内固定", "取出内固定", "颅脑", "脑挫裂伤", "软化灶", "肋骨", "锁骨",
    "肩关节", "肘关节", "腕关节", "髋关节", "膝关节", "踝关节",
]
SIGNATURE_BOILERPLATE = "(?:姓名|住院号|科室|床位号|医师签字|医生签字|签名|日期|手术记录|页码|第[0-9]+页)"
SIGNATURE_WORDS = ["签字", "签名"]
TRACE_WORDS = [
    "根据任务要求", "让我先整理", "我需要生成", "被鉴定人信息：", "委托单位：", "委托鉴定事项：", "伤残/三期候选清单", "候选清单分析",
    "[met;status=", "[uncertain;status=", "建议/范围：", "风险提示：", "**",
]
REQUIRED_OPENING = "根据委托单位提供的现有材料"
