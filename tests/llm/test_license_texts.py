"""Whole licences and notices against their texts."""

import textwrap

from motifloom.llm import license_scan

LIABLE = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
LOSS = "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
COPYRIGHT = "Copyright (c) 2024 Some Body and others. All rights reserved.\n\n"


def licenses_of(spark, texts):
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["license"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_whole_licences(spark):
    assert {n for n, _ in license_scan.TEMPLATES} - {n for n, _ in license_scan.WHOLE} == {"MIT"}
    names, texts = [], []
    for name, text in license_scan.TEMPLATES:
        wrapped = "\n".join(textwrap.fill(line, 60) for line in text.split("\n"))
        names += [name] * 3
        texts += [text, wrapped, COPYRIGHT * (len(text) > 200) + wrapped]
    # the beginnings that were the templates of BSD-3-Clause and ISC, completed here by what they lacked
    for name, more in (("BSD-3-Clause", LIABLE), ("ISC", LOSS)):
        begun = next(t for n, t in license_scan.TEMPLATES if n == name and len(t) > 200)
        assert begun.endswith("."), name
        names += [name] * 2
        texts += [f"{begun} {more}", f"{COPYRIGHT}{begun}\n{more}"]
    assert licenses_of(spark, texts) == names


def test_notices_name_their_version(spark):
    gpl = next(t for n, t in license_scan.TEMPLATES if n == "GPL-3.0" and 200 < len(t) < 2000)
    texts = [gpl, gpl.replace("version 3", "version 2"), gpl.replace("GNU General", "GNU Affero General")]
    assert licenses_of(spark, texts) == ["GPL-3.0", "GPL-2.0", "AGPL-3.0"]


def test_licences_inside_larger_texts(spark):
    mit = [t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 200][0]
    cut = [mit.index("The above"), mit.index("THE SOFTWARE IS")]
    mit = "\n\n".join((mit[: cut[0]], mit[cut[0] : cut[1]], mit[cut[1] :]))
    gpl = next(t for n, t in license_scan.TEMPLATES if n == "GPL-3.0" and 200 < len(t) < 2000).replace(" This program is dist", "\n\nThis program is dist").replace(" See the", "\n\nSee the")
    whole = dict(license_scan.WHOLE)
    story = "\n\n".join(f"Chapter {i} tells how the keeper of lamp number {i} went down to the harbour and what was found there." for i in range(40))
    names = ["MIT", "GPL-3.0", "BSD-3-Clause", "Apache-2.0"]
    texts = []
    for one in (mit, gpl, whole["BSD-3-Clause"], whole["Apache-2.0"]):
        wrapped = "\n".join(textwrap.fill(line, 60) for line in one.split("\n"))
        larger = f"{story}\n\n{wrapped}\n\n{story}"
        texts += [larger, larger.replace("\n", "\r\n"), larger.replace("\n\n", "\n \t\n")]
    # a paragraph that is hard-wrapped, between blank lines that hold blanks or end in CRLF
    flat = textwrap.fill(mit.replace("\n\n", " "), 60)
    texts += [f"{story}\n \n{flat}\n\t\n{story}", f"{story}\n\n{flat}\n\n{story}".replace("\n", "\r\n"), story]
    assert licenses_of(spark, texts) == [n for n in names for _ in range(3)] + ["MIT", "MIT", None]
