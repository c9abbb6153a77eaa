"""Where the published datasets lie below a data root, and the digests of their references."""

from __future__ import annotations

from .preparation import Spec

#: Folders, files and SHA-256 digests (fixed values).
COCO = "shared/COCO2014/images/train2014"
FAMILY = "01_RGB_Grounding/RefCOCO_family/raw"
GREF = "01_RGB_Grounding/gRefCOCO/archives"
SPOT = "02_RGBD_Grounding/SUN-Spot/archives"
SUN = "02_RGBD_Grounding/SUN-Spot/SUNRGBD_base/raw"
ARCHIVES = {
    "shared/COCO2014/archives/train2014.zip": "shared/COCO2014/images",
    "02_RGBD_Grounding/SUN-Spot/SUNRGBD_base/archives/SUNRGBD.zip": SUN,
}
DATASETS = (
    Spec("refcoco", f"{FAMILY}/refcoco/refs(unc).p", f"{FAMILY}/refcoco/instances.json", "D4A8DD3152F130127924F9D0F0EA30F4DC43EC19E1B47BC55AF972F90614F8BA", "coco2014", COCO),
    Spec("refcoco_plus", f"{FAMILY}/refcoco+/refs(unc).p", f"{FAMILY}/refcoco+/instances.json", "7DE24C182449758B9D9AE87D968B1F25831236A54D38D45408E2E0FDD318E802", "coco2014", COCO),
    Spec("refcocog", f"{FAMILY}/refcocog/refs(umd).p", f"{FAMILY}/refcocog/instances.json", "0331C7533537B67C2F7AC8C8BAB0DA2D379D1754C6F5C110FD79F70E17E7BDDB", "coco2014", COCO),
    Spec("grefcoco", f"{GREF}/grefs_unc.json", f"{GREF}/instances.json", "CC37C5FF95373C78A6A3F98B4C7BC67FDE387EA8514752A1392DB64223EB3366", "coco2014", COCO),
    Spec("sunspot", f"{SPOT}/refs(boulder).p", f"{SPOT}/instances.json", "6EE465478306DFC8776CACF86B4AE570A079991212E269C22D7829AFA2A3C18B", "sunrgbd", SUN, SUN),
)
#: The datasets whose union is split as one.
CORE, CORE_NAME = ("refcoco", "refcoco_plus", "refcocog"), "rgb_core_v1"
