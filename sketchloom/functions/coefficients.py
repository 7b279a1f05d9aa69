"""Coefficients of the learned distance and alignment-fraction models.

Fixed values, published under the Apache License 2.0 with the models they belong to; results
must equal those models', so they are stated as they are. Each model is linear in the features,
three reciprocals of weighted feature sums, and products of features with reciprocals.
"""

from __future__ import annotations

EPSILON = 1e-8
#: The sampling fold at which the models were fitted.
FOLD = 8

# --- fixed values: 11-coden layout -------------------------------------------------------
MOE_DENOMINATORS = (
    (1.0178887, 1.0135146, 1.0302181, 1.1205122),
    (1.0136223, 0.9803396, 1.0021964, 0.9839395),
    (0.9988935, 0.9690589, 0.9888171, 0.9817371),
)
MOE = (
    6.86905236142636, -5.85271800517096e-08, 7.43351941016881e-06, -1.95859228059721e-05, -8.44336369105416e-06,
    -11726.5478433625, -111109.682632437, 121000.895632267,
    -741.538955661909, -1894.53741972785, 2585.81964981999,
    -7744.5216892858, -18190.2514369096, 23306.3090989115,
    8352.82760552325, 19782.4294837312, -25518.2493259614,
)
MOE95_DENOMINATORS = (
    (1.0145656, 1.2708196, 1.2169829, 0.3904416),
    (0.8147527, 1.3389150, 2.0581364, -1.4624736),
    (1.6877678, 2.4390067, 0.7878482, 0.6697437),
)
MOE95 = (
    -1.69173585242774, -3.64716315423252e-08, 2.85880264052975e-05, -5.5597924264054e-05, -2.96208613804271e-05,
    1106.96550282022, -83.197177767225, -1671.88720051458,
    152.75590068948, 212.734805232395, 208.388739816682,
    -0.27860125939004, 2.27065806912198, -10.2977013026837,
    -250.681324281127, -403.751360812353, -137.96628693833,
)
# --- fixed values: 9- and 10-coden layouts -----------------------------------------------
MOE_DENOMINATORS_9 = (
    (1.0090536851341, 1.0013604061893, 1.03540226374509, 1.04270754727088),
    (1.0108940845453, 1.0010797461052, 0.98914550652945, 1.01536320288592),
    (1.0061957741437, 0.9957814716168, 0.98352379677340, 1.00951820561544),
)
MOE_9 = (
    -0.587100397752123, -7.93027271403258e-08, 4.98481429879899e-06, -1.63903694463017e-05, -4.93356600478016e-06,
    -14843.5350131617, 306478.144745683, -290254.345158429,
    -1781.00695309133, -1091.99589131905, 327.6575530681,
    47395.255680747, 47798.7112013701, -35574.6303634354,
    -45398.423188085, -46461.4920783106, 35045.3583333325,
)
MOE95_DENOMINATORS_9 = (
    (1.0196821174688, 0.9817771341602, 1.04637038371202, 1.02441485561367),
    (1.0163855061091, 0.9824051281495, 1.04908985213703, 1.01102197270052),
    (1.0074050784795, 1.0018402553389, 0.94654127396428, 0.94051319172603),
)
MOE95_9 = (
    10.7394186800999, -2.92835943410177e-08, 1.66112325940088e-05, -3.48757817098253e-05, -1.82725607919882e-05,
    3151.11534599359, -1300.37794535582, -1824.96575177919,
    -21820.9227396359, -30943.09511694, 10100.3465983902,
    25441.8492675468, 35763.8363380932, -3901.01958522226,
    -3669.6748819999, -4909.59256464219, -5653.59698386914,
)
# --- fixed values: BLAST-like alignment fraction -----------------------------------------
AF_DENOMINATORS = (
    (2.36775520439829, 2.17036643548818, -0.0977124271437818, -0.251063182363729, 2.19491057829433),
    (1.41850238263675, 2.15224961402778, -2.18587619877498, -2.21943802445092, 0.418474287083788),
    (0.990424249133548, 0.502163745411501, 5.7787290524088, 0.626839640715682, 0.638706160147675),
)
AF = (
    0.127498260534708, -1.51730137145957e-06, 9.48114616179122e-05, -0.000257916039708839, -7.85253629216324e-05, 1.96482915215685e-06,
    -1475.58996322769, 26.4698377745167, 529.387641078915,
    42.0602258298213, 92.3637001980455, -306.00755719743, -86.3482066935661,
    2.16630645286942, -0.674746089642152, 48.1147600903939, 3.39101087242059,
    -15.5481688297158, -26.7068442368566, 18.5142668221724, 20.4430437567379,
)
# --- fixed values: naive distance, scale and intercept -----------------------------------
NAIVE_11 = (0.1544286, 7.133e-4)
NAIVE_9 = (0.1557143, 9.961e-5)
NAIVE_RAMP = 0.01
