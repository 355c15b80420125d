"""Word lists, unit spellings and patterns that decide results. They must equal those of the published metric and pipeline."""

FUNCTION_WORDS = """a an and are as at be been being but by for from has have in into is it its of on or that the these this those to was
were which with within there here notably again also""".split()

CRITICAL_WORDS = """no not without absent negative unremarkable clear
right left bilateral unilateral ipsilateral contralateral
mild moderate severe minimal minimally small large tiny trace marked extensive subtle significant slight slightly grossly borderline
chronic acute focal diffuse stable new interval
mm cm mm2 cm2""".split()

#: Long unit spellings and the short one.
UNITS = {"mm": "millimeters millimetres millimeter millimetre".split(), "cm": "centimeters centimetres centimeter centimetre".split()}

W_CRITICAL, W_CONTENT, W_FUNCTION = 4.0, 2.0, 0.25

LATERALITY = "right left bilateral unilateral ipsilateral contralateral".split()
SEVERITY = """mild moderate severe minimal minimally small large tiny trace marked extensive subtle slight slightly grossly
borderline""".split()

NEGATION = "no not without absent negative unremarkable clear deny denies denied free".split()
ABNORMAL = """mild moderate severe fracture fractures fractured dislocation dislocated effusion edema consolidation opacity opacities
mass nodule nodules calcific calcification degenerative osteoarthritic osteoarthrosis arthrosis stenosis hernia tear thickening
prominence abnormal abnormality hyperinflation emphysema atelectasis scar scarring cardiomegaly infiltrate pneumonia infarct lesion
irregularity demineralization demineralisation collection cyst cysts tumor tumour neoplasm swelling contusion nonunion malalignment
destructive lytic sclerotic perinephric stranding polypoid polyp fibroids cholelithiasis spondylosis osteophytes
spondylolisthesis""".split()

#: Words that carry no anatomy for routing.
ROUTING_STOP = [*FUNCTION_WORDS, *"no not seen identified noted present appear appears appeared".split()]

#: Words of a label that name no anatomy.
LABEL_STOP = "no the and of is are normal unremarkable finding findings structures space spaces".split()

DROP, OTHER_FINDINGS, VERTEBRAE, DISCS = "__DROP__", "OTHERFINDINGS", "VERTEBRAE", "DISCSDEGENERATIVECHANGES"
FACET = r"\b(?:facet|facets|arthropath(?:y|ic))\b"

#: Anatomy words of the fields, for the fallback that needs no model.
ANATOMY = {
    "LUNGS": "lung lungs pulmonary parenchyma airspace consolidation infiltrate opacity nodule mass emphysema bronchic atelectasis interstitial",
    "LUNGS/AIRWAYS": "lung lungs pulmonary airway trachea bronchus",
    "PLEURA": "pleural pleura effusion pneumothorax",
    "PLEURALSPACES": "pleural pleura effusion pneumothorax",
    "HEART": "heart cardiac cardiomegaly pericardium",
    "CARDIOVASCULAR": "heart cardiac aorta vascular calcification",
    "HEARTANDMEDIASTINUM": "heart cardiac mediastinum pericardium aorta great vessels",
    "MEDIASTINUM": "mediastinum mediastinal hilar hilum adenopathy lymph node",
    "MEDIASTINALHILARLYMPHNODES": "mediastinum mediastinal hilar hilum adenopathy",
    "MEDIASTINUMHILA": "mediastinum mediastinal hilar hilum",
    "LYMPHNODES": "lymph node adenopathy nodal",
    "BONES": "bone osseous bony fracture cortic trabecular spondylosis",
    "OSSEOUSSTRUCTURES": "bone osseous bony fracture cortic",
    "CHESTWALLMUSCULOSKELETAL": "rib chest wall osseous muscle scapula clavicle",
    "JOINTS": "joint space arthritis arthrosis degenerative subluxation effusion dislocation alignment",
    "DISCSPACES": "disc space vertebral spondylosis",
    "DISCSDEGENERATIVECHANGES": "disc space vertebral spondylosis facet",
    "VERTEBRAE": "vertebral vertebra spine spondylosis compression body height",
    "VERTEBRALBODIES": "vertebral vertebra compression body height marrow",
    "ALIGNMENT": "alignment lordosis kyphosis scoliosis curvature straightening",
    "SOFTTISSUES": "soft tissue swelling tissues subcutaneous edema",
    "PARAVERTEBRALSOFTTISSUES": "paraspinal paravertebral soft tissue",
    "SPINALCORD": "cord thecal conus spinal canal stenosis",
    "BRAIN": "brain cerebral hemispheric parenchyma infarct mass",
    "ORBITS": "orbit orbital globe eyeball",
    "SINUSESANDMASTOIDS": "sinus sinusitis mastoid mastoiditis",
    "TENDONS": "tendon tendinosis tear rotator cuff supraspinatus infraspinatus subscapularis biceps",
    "MUSCLES": "muscle muscular edema atrophy",
    "LIGAMENTS": "ligament ligamentous acl pcl mcl lcl sprain",
    "CARTILAGE": "cartilage chondral chondropathy meniscus meniscal",
    "BURSAE": "bursa bursal bursitis",
    "PATELLA": "patella patellar",
    "OTHERFINDINGS": "",
}

#: Fences around an answer, a brace too many before a key, the span of an object, and pairs of strings that can be saved.
FENCE = r"(?m)^\s*```(?:json)?\s*|\s*```\s*$"
BRACES = r'\}\}\s*,\s*"(impression|fields)"'
OBJECT = r"(?s)(\{.*\})"
PAIR = r'"([^"]+)"\s*:\s*"((?:[^"\\]|\\.)*)"'

CLIP_TEMPLATE = 4000
TRUNCATED = "\n...[truncated]"
