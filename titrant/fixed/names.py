"""Printed names of the analytes by language (fixed values), in dictionary order.

A name that is the canonical one, in whatever case, needs no entry: it is looked up first.
"""

ENGLISH = [
    ("6690-2", ["WBC", "White Blood Cells", "White Blood Cell Count", "Leucocytes", "Leukocyte Count"]),
    ("789-8", ["RBC", "Red Blood Cells", "Red Blood Cell Count", "Erythrocyte Count"]),
    ("718-7", ["Hgb", "Hb", "Haemoglobin"]),
    ("4544-3", ["Hct", "HCT", "Haematocrit", "PCV", "Packed Cell Volume"]),
    ("777-3", ["PLT", "Platelet Count", "Thrombocytes"]),
    ("787-2", ["Mean Corpuscular Volume", "Mean Cell Volume"]),
    ("785-6", ["Mean Corpuscular Hemoglobin", "Mean Cell Hemoglobin"]),
    ("786-4", ["Mean Corpuscular Hemoglobin Concentration"]),
    ("788-0", ["Red Cell Distribution Width", "RDW-CV"]),
    ("32623-1", ["Mean Platelet Volume"]),
    ("2345-7", ["Blood Glucose", "Fasting Glucose", "FBG", "Blood Sugar", "Glu", "Glucose Fasting"]),
    ("3094-0", ["Blood Urea Nitrogen", "Urea Nitrogen"]),
    ("2160-0", ["Creat", "Cr", "Serum Creatinine"]),
    ("2951-2", ["Na", "Na+", "Serum Sodium"]),
    ("2823-3", ["K", "K+", "Serum Potassium"]),
    ("2075-0", ["Cl", "Cl-", "Serum Chloride"]),
    ("2028-9", ["Bicarbonate", "HCO3", "Total CO2", "TCO2"]),
    ("17861-6", ["Ca", "Ca2+", "Total Calcium", "Serum Calcium"]),
    ("1751-7", ["Alb", "Serum Albumin"]),
    ("2885-2", ["TP", "Serum Protein"]),
    ("6768-6", ["Alkaline Phosphatase", "Alk Phos"]),
    ("1742-6", ["Alanine Aminotransferase", "SGPT", "GPT", "ALAT"]),
    ("1920-8", ["Aspartate Aminotransferase", "SGOT", "GOT", "ASAT"]),
    ("1975-2", ["T. Bili", "TBili", "Bilirubin Total"]),
    ("2093-3", ["Cholesterol", "TC", "Chol"]),
    ("2085-9", ["HDL", "HDL-C", "Good Cholesterol"]),
    ("13457-7", ["LDL", "LDL-C", "Bad Cholesterol", "LDL Calculated"]),
    ("2571-8", ["TG", "Trig", "Trigs"]),
    ("13458-5", ["VLDL", "VLDL-C"]),
    ("3016-3", ["Thyroid Stimulating Hormone", "Thyrotropin"]),
    ("3024-7", ["FT4", "Free Thyroxine", "Thyroxine Free", "Free Thyroxine (Free T4)"]),
    ("3051-0", ["FT3", "Free Triiodothyronine"]),
    ("3026-2", ["T4", "Thyroxine"]),
    ("2324-2", ["Gamma-Glutamyl Transferase", "Gamma GT", "γ-GT", "GGTP"]),
    ("1968-7", ["D. Bili", "Conjugated Bilirubin", "DBili"]),
    ("1971-1", ["I. Bili", "Unconjugated Bilirubin"]),
    ("2532-0", ["Lactate Dehydrogenase", "LD"]),
    ("33914-3", ["Estimated GFR", "Glomerular Filtration Rate", "GFR"]),
    ("3084-1", ["UA", "Urate"]),
    ("14959-1", ["Urine Albumin", "Microalbuminuria", "MAU"]),
    ("2777-1", ["Phosphorus", "Phos", "PO4", "Inorganic Phosphorus"]),
    ("19123-9", ["Mg", "Mg2+", "Serum Magnesium"]),
    ("4548-4", ["A1C", "Hemoglobin A1c", "Glycated Hemoglobin", "Glycosylated Hemoglobin"]),
    ("2498-4", ["Fe", "Serum Iron"]),
    ("2276-4", ["Serum Ferritin"]),
    ("1989-3", ["25-OH Vitamin D", "25-Hydroxyvitamin D", "Vit D"]),
    ("1988-5", ["C-Reactive Protein", "C Reactive Protein"]),
    ("4537-7", ["Sed Rate", "Erythrocyte Sedimentation Rate"]),
    ("751-8", ["Neutrophil Count", "NEU", "Neut", "Absolute Neutrophils"]),
    ("731-0", ["Lymphocyte Count", "Lymph", "Absolute Lymphocytes"]),
    ("742-7", ["Monocyte Count", "Mono", "Absolute Monocytes"]),
    ("711-2", ["Eosinophil Count", "EOS", "Eos", "Absolute Eosinophils"]),
    ("704-7", ["Basophil Count", "Baso", "Absolute Basophils"]),
    ("2986-8", ["Total Testosterone", "Testosterone Total"]),
    ("2991-8", ["Free Testosterone Index", "FTI"]),
    ("13967-5", ["Sex Hormone Binding Globulin", "Sex Hormone-binding Globulin"]),
    ("2132-9", ["B12", "Cobalamin", "Cyanocobalamin"]),
    ("13965-9", ["Hcy", "Total Homocysteine"]),
    ("22322-2", ["Hepatitis B Surface Antibody", "Anti-HBs", "HBs Ab"]),
    ("5195-3", ["Hepatitis B Surface Antigen", "HBsAg Qualitative", "HBs Ag"]),
    ("16128-1", ["Hepatitis C Antibody", "Anti-HCV", "HCV Antibody"]),
    ("75622-1", ["HIV", "HIV Ag/Ab", "HIV 1/2 Ab/Ag", "HIV Combo", "HIV Antigen/Antibody"]),
    ("5291-0", ["RPR Qualitative", "Rapid Plasma Reagin"]),
    ("5292-8", ["VDRL Qualitative"]),
    ("14677-9", ["Antinuclear Antibody", "ANA Screen"]),
    ("13335-5", ["Helicobacter pylori", "H. pylori Ag", "H pylori Antigen"]),
    ("73963-7", ["QuantiFERON", "T-SPOT", "IGRA", "TB Interferon Gamma"]),
    ("2335-8", ["FOBT", "Fecal Occult Blood", "Stool OB", "FOB"]),
    ("24108-3", ["Carbohydrate Antigen 19-9", "CA19-9", "Cancer Antigen 19-9"]),
    ("3091-6", ["Blood Urea", "Serum Urea"]),
    ("43396-1", ["Non HDL Cholesterol", "Non-HDL-C"]),
    ("2965-2", ["Specific Gravity", "SG", "Urine SG"]),
    ("2756-5", ["pH"]),
    ("20454-5", ["Protein (Urine)", "UA Protein", "Urine Protein Qualitative"]),
    ("25428-4", ["Glucose (Urine)", "UA Glucose", "Urine Sugar"]),
    ("2514-9", ["Ketones (Urine)", "UA Ketones"]),
    ("5794-3", ["Blood (Urine)", "UA Blood", "Urine RBC", "Occult Blood (Urine)"]),
    ("5799-2", ["WBC Esterase", "LE", "Leukocytes (Urine)"]),
    ("5802-4", ["Nitrite (Urine)", "UA Nitrite"]),
    ("1990-1", ["Bilirubin (Urine)", "UA Bilirubin"]),
    ("13658-0", ["Urine Urobilinogen", "UBG"]),
    ("883-9", ["ABO", "Blood Group", "Blood Type ABO"]),
    ("10331-7", ["Rh Factor", "Rh", "Rhesus Factor"]),
    ("34532-2", ["Blood Group and Type", "ABO & Rh"]),
    ("2106-3", ["Pregnancy Test", "Urine Pregnancy", "hCG Qualitative"]),
    ("37874-4", ["PCT"]),
    ("32207-3", ["Platelet Distribution Width", "Platelets Distribution Width"]),
    ("53553-4", ["eAG", "EAG", "Average Glucose"]),
    ("53115-2", ["IG", "Imature Granulocytes", "Immature Grans"]),
    ("58413-6", ["Nucleated Red Blood Cells", "Nucleated Red Blood Cell", "Nucleated RBC"]),
]

FRENCH = [
    ("6690-2", ["Leucocytes", "GB", "Globules blancs"]),
    ("789-8", ["Érythrocytes", "GR", "Globules rouges", "Hématies"]),
    ("718-7", ["Hémoglobine", "Hb"]),
    ("4544-3", ["Hématocrite", "Hte"]),
    ("777-3", ["Plaquettes", "Thrombocytes", "PLQ"]),
    ("787-2", ["VGM", "Volume Globulaire Moyen"]),
    ("785-6", ["TCMH", "Teneur Corpusculaire Moyenne en Hémoglobine"]),
    ("786-4", ["CCMH", "Concentration Corpusculaire Moyenne en Hémoglobine"]),
    ("788-0", ["IDR", "Indice de Distribution des Rouges"]),
    ("32623-1", ["VPM", "Volume Plaquettaire Moyen"]),
    ("2345-7", ["Glycémie", "Glucose sanguin", "Glycémie à jeun"]),
    ("3094-0", ["Urée", "Azote uréique"]),
    ("2160-0", ["Créatinine", "Créat"]),
    ("2951-2", ["Na", "Natrémie"]),
    ("2823-3", ["K", "Kaliémie"]),
    ("2075-0", ["Chlore", "Cl", "Chlorémie"]),
    ("2028-9", ["CO2 total", "Bicarbonates", "HCO3"]),
    ("17861-6", ["Ca", "Calcémie"]),
    ("1751-7", ["Albumine", "Alb"]),
    ("2885-2", ["Protéines totales", "PT"]),
    ("6768-6", ["PAL", "Phosphatase alcaline", "Phosphatases alcalines"]),
    ("1742-6", ["ALAT", "Alanine aminotransférase", "GPT", "TGP"]),
    ("1920-8", ["ASAT", "Aspartate aminotransférase", "GOT", "TGO"]),
    ("1975-2", ["Bilirubine totale", "BT"]),
    ("2093-3", ["Cholestérol total", "CT"]),
    ("2085-9", ["HDL-cholestérol", "HDL"]),
    ("13457-7", ["LDL-cholestérol", "LDL"]),
    ("2571-8", ["Triglycérides", "TG"]),
    ("13458-5", ["VLDL-cholestérol", "VLDL"]),
    ("3016-3", ["Thyréostimuline"]),
    ("3024-7", ["T4 libre", "T4L", "Thyroxine libre"]),
    ("3051-0", ["T3 libre", "T3L"]),
    ("3026-2", ["T4 totale", "T4"]),
    ("2324-2", ["Gamma GT", "γ-GT"]),
    ("1968-7", ["Bilirubine directe", "BD", "Bilirubine conjuguée"]),
    ("1971-1", ["Bilirubine indirecte", "BI", "Bilirubine non conjuguée"]),
    ("2532-0", ["Lactate déshydrogénase"]),
    ("33914-3", ["DFGe", "Débit de filtration glomérulaire estimé"]),
    ("3084-1", ["Acide urique", "AU"]),
    ("14959-1", ["Microalbumine", "Microalbuminurie"]),
    ("2777-1", ["Phosphore", "Phosphates"]),
    ("19123-9", ["Magnésium", "Mg"]),
    ("4548-4", ["Hémoglobine glyquée"]),
    ("2498-4", ["Fer sérique", "Fe"]),
    ("2276-4", ["Ferritine"]),
    ("1989-3", ["Vitamine D", "25-OH Vitamine D"]),
    ("1988-5", ["Protéine C réactive", "PCR"]),
    ("4537-7", ["VS", "Vitesse de sédimentation"]),
    ("751-8", ["Neutrophiles", "PNN"]),
    ("711-2", ["Éosinophiles", "PNE"]),
    ("704-7", ["Basophiles", "PNB"]),
    ("2986-8", ["Testostérone"]),
    ("2991-8", ["Testostérone libre"]),
    ("13967-5", ["Protéine de liaison des hormones sexuelles"]),
    ("2132-9", ["Vitamine B12", "Cobalamine"]),
    ("13965-9", ["Homocystéine"]),
    ("22322-2", ["Anticorps anti-HBs"]),
    ("5195-3", ["Antigène HBs"]),
    ("16128-1", ["Anticorps anti-VHC"]),
    ("75622-1", ["VIH Ag/Ac"]),
    ("14677-9", ["AAN", "Anticorps antinucléaires"]),
    ("13335-5", ["Helicobacter pylori"]),
    ("73963-7", ["IGRA", "QuantiFERON"]),
    ("2335-8", ["Sang occulte dans les selles"]),
    ("24108-3", ["Antigène carbohydrate 19-9"]),
    ("3091-6", ["Urée"]),
    ("43396-1", ["Cholestérol non-HDL"]),
    ("2965-2", ["Densité urinaire"]),
    ("2756-5", ["pH urinaire"]),
    ("20454-5", ["Protéines urinaires"]),
    ("25428-4", ["Glucose urinaire"]),
    ("2514-9", ["Corps cétoniques urinaires"]),
    ("5794-3", ["Sang urinaire"]),
    ("5799-2", ["Estérase leucocytaire"]),
    ("5802-4", ["Nitrites urinaires"]),
    ("1990-1", ["Bilirubine urinaire"]),
    ("13658-0", ["Urobilinogène"]),
    ("883-9", ["Groupe sanguin ABO"]),
    ("10331-7", ["Facteur Rhésus"]),
    ("34532-2", ["Groupe sanguin et Rhésus"]),
    ("2106-3", ["Test de grossesse urinaire"]),
    ("37874-4", ["Plaquettocrite"]),
    ("32207-3", ["IDT", "Indice de Distribution des Thrombocytes"]),
    ("53553-4", ["Glucose moyen estimé"]),
    ("53115-2", ["Granulocytes immatures"]),
    ("58413-6", ["Érythroblastes"]),
]

ARABIC = [
    ("6690-2", ["كريات الدم البيضاء", "خلايا الدم البيضاء"]),
    ("789-8", ["كريات الدم الحمراء", "خلايا الدم الحمراء"]),
    ("718-7", ["الهيموغلوبين", "هيموجلوبين"]),
    ("4544-3", ["الهيماتوكريت", "نسبة الدم المضغوط"]),
    ("777-3", ["الصفائح الدموية", "صفيحات"]),
    ("787-2", ["متوسط حجم الكرية"]),
    ("785-6", ["متوسط هيموغلوبين الكرية"]),
    ("786-4", ["تركيز هيموغلوبين الكرية"]),
    ("788-0", ["عرض توزيع الكريات الحمراء"]),
    ("32623-1", ["متوسط حجم الصفائح"]),
    ("2345-7", ["الجلوكوز", "سكر الدم", "غلوكوز"]),
    ("3094-0", ["يوريا الدم", "نيتروجين اليوريا"]),
    ("2160-0", ["الكرياتينين", "كرياتينين"]),
    ("2951-2", ["الصوديوم", "صوديوم"]),
    ("2823-3", ["البوتاسيوم", "بوتاسيوم"]),
    ("2075-0", ["الكلوريد", "كلوريد"]),
    ("2028-9", ["ثاني أكسيد الكربون", "بيكربونات"]),
    ("17861-6", ["الكالسيوم", "كالسيوم"]),
    ("1751-7", ["الألبومين", "زلال"]),
    ("2885-2", ["البروتين الكلي", "بروتين"]),
    ("6768-6", ["الفوسفاتاز القلوي", "فوسفاتاز"]),
    ("1742-6", ["إنزيم الكبد ALT", "ناقلة أمين الألانين"]),
    ("1920-8", ["إنزيم الكبد AST", "ناقلة أمين الأسبارتات"]),
    ("1975-2", ["البيليروبين الكلي", "بيليروبين"]),
    ("2093-3", ["الكوليسترول الكلي", "كولسترول"]),
    ("2085-9", ["كوليسترول HDL", "الكوليسترول الجيد"]),
    ("13457-7", ["كوليسترول LDL", "الكوليسترول الضار"]),
    ("2571-8", ["الدهون الثلاثية", "تريغليسيريد"]),
    ("13458-5", ["كوليسترول VLDL"]),
    ("3016-3", ["هرمون الغدة الدرقية TSH", "الهرمون المحفز للغدة الدرقية"]),
    ("3024-7", ["T4 الحر", "الثيروكسين الحر"]),
    ("3051-0", ["T3 الحر"]),
    ("3026-2", ["T4 الكلي", "الثيروكسين"]),
    ("2324-2", ["غاما غلوتاميل"]),
    ("1968-7", ["البيليروبين المباشر"]),
    ("1971-1", ["البيليروبين غير المباشر"]),
    ("2532-0", ["نازعة هيدروجين اللاكتات"]),
    ("33914-3", ["معدل الترشيح الكبيبي"]),
    ("3084-1", ["حمض اليوريك", "يوريك"]),
    ("14959-1", ["الألبومين الدقيق", "ميكروألبومين"]),
    ("2777-1", ["الفوسفات", "فوسفور"]),
    ("19123-9", ["المغنيسيوم", "مغنيسيوم"]),
    ("4548-4", ["الهيموغلوبين السكري"]),
    ("2498-4", ["الحديد", "حديد"]),
    ("2276-4", ["الفيريتين", "فيريتين"]),
    ("1989-3", ["فيتامين د", "فيتامين D"]),
    ("1988-5", ["البروتين التفاعلي C"]),
    ("4537-7", ["سرعة الترسيب"]),
    ("751-8", ["العدلات", "نيتروفيل"]),
    ("731-0", ["الخلايا الليمفاوية", "لمفاويات"]),
    ("742-7", ["الوحيدات", "مونوسيت"]),
    ("711-2", ["الحمضات", "إيوزينوفيل"]),
    ("704-7", ["القعدات", "بازوفيل"]),
    ("2986-8", ["التستوستيرون"]),
    ("2991-8", ["التستوستيرون الحر"]),
    ("13967-5", ["الغلوبيولين الرابط للهرمونات الجنسية"]),
    ("2132-9", ["فيتامين ب12"]),
    ("13965-9", ["الهوموسيستين"]),
    ("22322-2", ["أجسام مضادة لسطح التهاب الكبد ب"]),
    ("5195-3", ["مستضد سطح التهاب الكبد ب"]),
    ("16128-1", ["أجسام مضادة لفيروس الكبد سي"]),
    ("75622-1", ["فحص فيروس نقص المناعة"]),
    ("14677-9", ["الأجسام المضادة للنواة"]),
    ("13335-5", ["جرثومة المعدة"]),
    ("73963-7", ["اختبار السل"]),
    ("2335-8", ["دم خفي في البراز"]),
    ("24108-3", ["مستضد السرطان 19-9"]),
    ("3091-6", ["اليوريا"]),
    ("43396-1", ["كوليسترول غير HDL"]),
    ("2965-2", ["الكثافة النوعية"]),
    ("2756-5", ["درجة الحموضة"]),
    ("20454-5", ["بروتين البول"]),
    ("25428-4", ["سكر البول"]),
    ("2514-9", ["كيتونات البول"]),
    ("5794-3", ["دم في البول"]),
    ("5799-2", ["إنزيم الكريات البيضاء"]),
    ("5802-4", ["نتريت البول"]),
    ("1990-1", ["بيليروبين البول"]),
    ("13658-0", ["يوروبيلينوجين"]),
    ("883-9", ["فصيلة الدم ABO"]),
    ("10331-7", ["عامل الريسوس"]),
    ("34532-2", ["فصيلة الدم"]),
    ("2106-3", ["اختبار الحمل"]),
    ("37874-4", ["نسبة الصفائح"]),
    ("32207-3", ["عرض توزيع الصفائح"]),
    ("53553-4", ["الغلوكوز المتوسط المقدر"]),
    ("53115-2", ["الخلايا الحبيبية غير الناضجة"]),
    ("58413-6", ["كريات الدم الحمراء المنواة"]),
]

VIETNAMESE = [
    ("6690-2", ["Bạch cầu", "BC", "Số lượng bạch cầu"]),
    ("789-8", ["Hồng cầu", "HC", "Số lượng hồng cầu"]),
    ("718-7", ["Hb", "Huyết sắc tố"]),
    ("4544-3", ["Hct", "Dung tích hồng cầu"]),
    ("777-3", ["Tiểu cầu", "TC", "Số lượng tiểu cầu"]),
    ("787-2", ["Thể tích trung bình hồng cầu"]),
    ("785-6", ["Lượng huyết sắc tố trung bình hồng cầu"]),
    ("786-4", ["Nồng độ huyết sắc tố trung bình hồng cầu"]),
    ("788-0", ["Độ phân bố hồng cầu"]),
    ("32623-1", ["Thể tích trung bình tiểu cầu"]),
    ("2345-7", ["Đường huyết", "Glucose máu", "Đường máu"]),
    ("3094-0", ["Ure máu", "Nitơ urê máu"]),
    ("2160-0", ["Creatinin"]),
    ("2951-2", ["Natri", "Na"]),
    ("2823-3", ["Kali", "K"]),
    ("2075-0", ["Clo", "Cl"]),
    ("2028-9", ["Bicarbonat"]),
    ("17861-6", ["Canxi", "Ca"]),
    ("1751-7", ["Alb"]),
    ("2885-2", ["Protein toàn phần", "Đạm toàn phần"]),
    ("6768-6", ["Phosphatase kiềm"]),
    ("1742-6", ["SGPT", "GPT"]),
    ("1920-8", ["SGOT", "GOT"]),
    ("1975-2", ["Bilirubin toàn phần", "Bilirubin TP"]),
    ("2093-3", ["Cholesterol toàn phần", "Cholesterol TP"]),
    ("2085-9", ["HDL", "Cholesterol HDL"]),
    ("13457-7", ["LDL", "Cholesterol LDL"]),
    ("2571-8", ["Triglyceride", "TG", "Mỡ trung tính"]),
    ("13458-5", ["VLDL", "Cholesterol VLDL"]),
    ("3016-3", ["Hormone kích thích tuyến giáp"]),
    ("3024-7", ["FT4", "T4 tự do"]),
    ("3051-0", ["FT3", "T3 tự do"]),
    ("3026-2", ["T4", "T4 toàn phần"]),
    ("2324-2", ["Gamma GT"]),
    ("1968-7", ["Bilirubin trực tiếp", "Bilirubin TT"]),
    ("1971-1", ["Bilirubin gián tiếp", "Bilirubin GT"]),
    ("2532-0", ["Lactate dehydrogenase"]),
    ("33914-3", ["Mức lọc cầu thận ước tính"]),
    ("3084-1", ["Acid uric", "Axit uric"]),
    ("14959-1", ["Albumin niệu vi lượng"]),
    ("2777-1", ["Phospho"]),
    ("19123-9", ["Magiê", "Mg"]),
    ("4548-4", ["Hemoglobin glycat hóa"]),
    ("2498-4", ["Sắt huyết thanh", "Fe"]),
    ("1989-3", ["25-OH Vitamin D"]),
    ("1988-5", ["Protein phản ứng C"]),
    ("4537-7", ["Tốc độ lắng máu"]),
    ("751-8", ["Bạch cầu trung tính", "Neutrophil"]),
    ("731-0", ["Bạch cầu lympho", "Lymphocyte"]),
    ("742-7", ["Bạch cầu mono", "Monocyte"]),
    ("711-2", ["Bạch cầu ái toan", "Eosinophil"]),
    ("704-7", ["Bạch cầu ái kiềm", "Basophil"]),
    ("2991-8", ["Testosterone tự do"]),
    ("22322-2", ["Kháng thể bề mặt viêm gan B"]),
    ("5195-3", ["Kháng nguyên bề mặt viêm gan B"]),
    ("16128-1", ["Kháng thể viêm gan C"]),
    ("75622-1", ["HIV", "Xét nghiệm HIV"]),
    ("14677-9", ["Kháng thể kháng nhân"]),
    ("13335-5", ["Vi khuẩn HP"]),
    ("73963-7", ["IGRA", "Xét nghiệm lao"]),
    ("2335-8", ["Máu ẩn trong phân"]),
    ("3091-6", ["Ure"]),
    ("2965-2", ["Tỷ trọng nước tiểu"]),
    ("2756-5", ["pH nước tiểu"]),
    ("20454-5", ["Protein nước tiểu", "Đạm niệu"]),
    ("25428-4", ["Glucose nước tiểu", "Đường niệu"]),
    ("2514-9", ["Ketone nước tiểu", "Xeton niệu"]),
    ("5794-3", ["Máu nước tiểu", "Hồng cầu niệu"]),
    ("5799-2", ["Bạch cầu esterase"]),
    ("5802-4", ["Nitrit nước tiểu"]),
    ("1990-1", ["Bilirubin nước tiểu"]),
    ("883-9", ["Nhóm máu ABO"]),
    ("10331-7", ["Yếu tố Rh"]),
    ("34532-2", ["Nhóm máu"]),
    ("2106-3", ["Xét nghiệm thai", "hCG nước tiểu"]),
    ("37874-4", ["PCT"]),
    ("32207-3", ["Độ phân bố tiểu cầu"]),
    ("53553-4", ["Đường máu trung bình ước tính"]),
    ("53115-2", ["Bạch cầu hạt non"]),
    ("58413-6", ["Hồng cầu có nhân"]),
]

LANGUAGES = {"en": ENGLISH, "fr": FRENCH, "ar": ARABIC, "vn": VIETNAMESE}


def names_of(code: str) -> dict[str, list[str]]:
    """Names of a code by language, in the order of the tables."""
    return {lang: names for lang, table in LANGUAGES.items() for c, names in table if c == code}
