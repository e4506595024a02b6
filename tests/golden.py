"""Score vectors of questions whose confidence is known."""

# Score vectors of questions whose confidence is known, of the web store and of uploads.
GOLDEN = {
    "fee": [0.9909, 0.9652, 0.8097, 0.6579, 0.6067, 0.0917, 0.0855, 0.0683, 0.0526, 0.0426, 0.0145, 0.0128, 0.0087, 0.0073, 0.0019],
    "curriculum": [0.9632, 0.9427, 0.9371, 0.9308, 0.9188, 0.9154, 0.8971, 0.8803, 0.8685, 0.8581, 0.8308, 0.7220, 0.6738, 0.3324, 0.2883],
    "eligibility": [0.9956, 0.9950, 0.9940, 0.9940, 0.9940, 0.9940, 0.9940, 0.9914, 0.9353, 0.7603, 0.7444, 0.6723, 0.5859, 0.4489, 0.0645],
    "head": [0.0873, 0.0092, 0.0086, 0.0084, 0.0072, 0.0045, 0.0026, 0.0015, 0.0013, 0.0006, 0.0003, 0.0003, 0.0002, 0.0002, 0.0001],
    "english": [0.5610, 0.2186, 0.1638, 0.1282, 0.1271, 0.0956, 0.0613, 0.0420, 0.0366, 0.0353, 0.0338, 0.0249, 0.0164, 0.0143, 0.0061],
    "deputy": [0.5352, 0.3861, 0.3779, 0.0755, 0.0704, 0.0687, 0.0582, 0.0447, 0.0390, 0.0340, 0.0250, 0.0207, 0.0202, 0.0124, 0.0088],
    "hostel": [0.9998, 0.9971, 0.7539, 0.1601, 0.0549, 0.0488, 0.0118, 0.0095, 0.0079, 0.0075, 0.0033, 0.0029, 0.0017, 0.0011, 0.0007],
    "placement": [0.1098, 0.0633, 0.0125, 0.0081, 0.0032, 0.0024, 0.0022, 0.0021, 0.0020, 0.0014, 0.0014, 0.0012, 0.0011, 0.0007, 0.0003],
    "sports": [0.9970, 0.9967, 0.1032, 0.0191, 0.0189, 0.0178, 0.0025, 0.0020, 0.0015, 0.0013, 0.0010, 0.0008, 0.0003, 0.0001, 0.0000],
    "no head": [0.6151, 0.3906, 0.3220, 0.2821, 0.2319, 0.1685, 0.1677, 0.0923, 0.0921, 0.0851, 0.0823, 0.0598, 0.0480, 0.0037, 0.0003],
    "mba": [0.0919, 0.0806, 0.0728, 0.0531, 0.0270, 0.0266, 0.0180, 0.0140, 0.0135, 0.0086, 0.0068, 0.0033, 0.0010, 0.0004, 0.0003],
    "other campus": [0.0213, 0.0193, 0.0171, 0.0131, 0.0123, 0.0107, 0.0076, 0.0074, 0.0036, 0.0035, 0.0026, 0.0017, 0.0004, 0.0002, 0.0001],
    "single": [0.9],
}
GOLDEN_UPLOAD = {
    "classes": [0.7418, 0.6886, 0.4577, 0.3709],
    "mid semester": [0.6908, 0.3308, 0.2763, 0.2749],
    "holidays": [0.1646, 0.0775, 0.0527, 0.0523],
    "end semester": [0.9557, 0.8555, 0.1070, 0.0469],
    "festival": [0.2532, 0.0005, 0.0004, 0.0003],
    "vacation": [0.2208, 0.0373, 0.0200, 0.0100],
    "one day": [0.1828, 0.0207, 0.0100, 0.0050],
    "last day": [0.5562, 0.0041, 0.0020, 0.0010],
    "no head": [0.0001, 0.0001, 0.0001, 0.0000],
    "no fee": [0.0000, 0.0000, 0.0000, 0.0000],
    "no hostel": [0.0000, 0.0000, 0.0000, 0.0000],
    "no placement": [0.0021, 0.0012, 0.0008, 0.0005],
    "no eligibility": [0.0010, 0.0004, 0.0003, 0.0002],
    "no principal": [0.0101, 0.0078, 0.0050, 0.0030],
}
