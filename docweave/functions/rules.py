"""Rule tables of the legal corpus: fixed values that results depend on, stated as they have to be."""

#: Folders of the corpus and the document types they hold.
FOLDER_TYPES = {"歷史訴願決定書": "decision", "相關法規": "statute", "行政函釋": "interpretation", "司法院釋字及行政判解": "precedent"}

#: Statutes that citations may name.
CITED_STATUTES = [
    "廢棄物清理法", "噪音管制法", "空氣污染防制法", "空氣汙染防制法", "建築法", "洗錢防制法", "行政罰法", "行政程序法",
    "行政執行法", "訴願法", "民法", "政府資訊公開法", "公寓大廈管理條例", "道路交通管理處罰條例", "停車場法", "毒品危害防制條例",
]

#: The same in the order of the knowledge base, with three stems of names.
SCANNED_STATUTES = [
    "廢棄物清理法", "噪音管制法", "空氣污染防制法", "空氣汙染防制法", "建築法", "洗錢防制法", "行政罰法", "行政程序法", "行政執行法", "訴願法",
    "政府資訊公開法", "公寓大廈管理條例", "道路交通管理處罰條例", "民法", "都市更新", "停車場法", "毒品危害防制條例", "社會救助", "工廠登記",
]

#: Variant spellings and the names they stand for.
ALIASES = {"空氣汙染防制法": "空氣污染防制法"}

#: Headings of decisions by their role, and markers of the two kinds of rulings.
DECISION_HEADINGS = {"main_text": "主文", "facts": "事實", "reasons": "理由", "teaching": "教示"}
INTERPRETATION_MARKERS = ["主旨", "說明", "結論", "附件"]
PRECEDENT_MARKERS = ["主文", "事實", "理由", "事實及理由", "爭點", "解釋文", "解釋理由書"]

#: Case types by keyword, first hit wins.
CASE_TYPES = [
    ("廢棄物清理法", "違反廢棄物清理法事件"), ("噪音管制法", "違反噪音管制法事件"), ("空氣污染防制法", "違反空氣污染防制法事件"),
    ("空氣汙染", "違反空氣污染防制法事件"), ("建築法", "違反建築法事件"), ("違章建築", "違章建築事件"), ("洗錢防制法", "違反洗錢防制法事件"),
    ("政府資訊", "申請提供政府資訊事件"), ("公寓大廈", "公寓大廈管理條例事件"), ("道路交通", "道路交通管理處罰條例事件"),
]

#: A case type's parent statute by keyword, first hit wins.
PARENT_STATUTES = [
    ("廢棄物清理法", "廢棄物清理法"), ("噪音管制法", "噪音管制法"), ("空氣污染防制法", "空氣污染防制法"), ("空氣汙染", "空氣污染防制法"),
    ("建築法", "建築法"), ("違章建築", "建築法"), ("洗錢防制法", "洗錢防制法"), ("政府資訊", "政府資訊公開法"),
    ("公寓大廈", "公寓大廈管理條例"), ("道路交通", "道路交通管理處罰條例"),
]

#: Keywords that tell two case types of one parent law.
PARENT_WORDS = ["廢棄物清理法", "噪音管制法", "空氣污染防制法", "建築法", "洗錢防制法", "政府資訊", "公寓大廈", "道路交通"]

#: Procedural statutes, for recommendations and for similarities.
PROCEDURAL_IN_ADVICE = ["訴願法", "行政程序法", "行政執行法", "行政院及各級行政機關訴願審議委員會審議規則"]
PROCEDURAL_IN_CASES = ["訴願法", "行政程序法", "行政院及各級行政機關訴願審議委員會審議規則"]
