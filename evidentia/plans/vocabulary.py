"""Small vocabularies the label queries run on; operators take any."""

from __future__ import annotations

from evidentia.operators.labelling import RecordRules

RECORDS = RecordRules(
    openings=[
        ("referee", "peer_review_report", True, ["review for", "referee report", "decision letter", "author response"]),
        ("mended", "erratum_correction", True, ["erratum", "corrigendum", "correction to", "correction :"]),
        ("taken_back", "retraction", True, ["retraction", "retracted", "withdrawn"]),
        ("opinion", "editorial_commentary", False, ["editorial", "comment on", "commentary", "reply to"]),
        ("numbered", "book_or_chapter", False, ["chapter #"]),
    ],
    codes=[("Editorial", "editorial_commentary", []), ("Book", "book_or_chapter", ["JournalArticle"]), ("Dataset", "dataset_or_software", ["JournalArticle", "Conference"])],
    hints=[("LettersAndComments", "editorial_commentary")],
    research=["Review", "CaseReport", "Study"],
    watch={"survey": ["survey"], "named_project": ["project"]},
)
STAGES = {"imaging": ["electron microscopy", "imaging"], "tracing": ["tracing", "segmentation"], "checking": ["annotations", "proofreaders"], "analysis": ["motifs", "models", "wiring"]}
METHODS = {"sparse_tracing": ["sparse tracing"], "automated_segmentation": ["automated segmentation"], "graph_view": ["graph based"]}
GENERAL_METHODS = {"microscopy": ["electron microscopy"], "volume_data": ["volumes", "dataset"]}
STRUCTURES = {"mushroom_body": ["mushroom body", "mushroom bodies"], "lateral_line": ["lateral line"], "cortex": ["cortex"]}
#: What a structure says about the organism where the words do not settle it first.
OWNERS = {"mushroom_body": "insect", "lateral_line": "fish"}
ORGANISMS = {"mouse": ["mouse", "mice"], "fish": ["zebrafish"], "insect": ["locusts", "beetle", "fly"], "bird": ["songbird"]}
TRAINING = ["training course", "training courses", "curriculum", "workshop", "tutorial", "summer school", "students"]
MACHINES = ["neural network", "neural networks", "deep learning", "classifier", "trained network", "training data"]
